"""Operators for training data on NULLs, ties, repeated rows, long texts, empty tables, against brute force or held-out truth."""

import math
import random
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphoquarry.llm.clusters import cut_tree, similarity_clusters, ward
from morphoquarry.llm.leakage import Items, fingerprint_shape, gram_hashes, leaks, least_run, readings, runs, winnow, words
from morphoquarry.llm import leakage
from morphoquarry.llm.packing import measured, packed, plan
from morphoquarry.llm.percentiles import merged, quantiles, sketches
from morphoquarry.llm.relsketch import RelSketch
from morphoquarry.llm.subjects import sentences, subject_areas


# percentiles


@pytest.mark.parametrize("high", [True, False])
@pytest.mark.parametrize("order", ["sorted", "reversed", "random"])
def test_sketch_error_is_relative(high, order):
    n, rng = 200_000, np.random.default_rng(5)
    x = rng.lognormal(0, 2, n)
    x = np.sort(x) if order == "sorted" else np.sort(x)[::-1] if order == "reversed" else x
    parts = [RelSketch(32, high).update(p) for p in np.array_split(x, 23)]
    one = RelSketch.load(parts[0].dump())
    for p in parts[1:]:
        one.merge(RelSketch.load(p.dump()))
    assert one.n == n and sum(len(v.values) for v in one.levels) < 6000
    true = np.sort(x)
    for q in (0.0001, 0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9999):
        rank = np.searchsorted(true, one.quantiles([q])[0], "right") / n
        assert abs(rank - q) <= one.rank_error(q, 4) + 1 / n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=150), st.booleans())
def test_small_sketches_are_exact(values, high):
    one = RelSketch(32, high).update(np.array(values + [math.nan]))
    true = sorted(values)
    for q in (0.01, 0.5, 0.99):
        assert one.quantiles([q])[0] == true[max(1, math.ceil(q * len(true) - 1e-9)) - 1]


def test_sketches_of_groups_and_days(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None]), rng.randrange(3), rng.choice([None, math.nan, rng.gauss(0, 1)])) for _ in range(5000)] + [("empty", 1, None)]
    df = spark.createDataFrame(rows, "grp string, day int, v double").withColumn("measure_", F.lit(1))
    daily = sketches(df, ["grp", "day"], ["v"])
    got = {(r.grp, r.percentile): r for r in quantiles(merged(daily, ["grp", "measure"]), ["grp", "measure"]).collect()}
    for g in ("a", None):
        real = np.sort([r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]])
        for q in (0.01, 0.5, 0.99):
            r = got[g, q]
            assert r.n == len(real) and abs(np.searchsorted(real, r.value, "right") / len(real) - q) <= 4 / 3 * r.rank_error + 2 / len(real)
    assert ("empty", 0.5) not in got
    assert quantiles(sketches(df.limit(0), ["grp"], ["v"]), ["grp", "measure"]).count() == 0


# clusters


def test_clusters(spark):
    rng = np.random.default_rng(4)
    rows, truth, i = [], {}, 0
    for g, centres in (("a", [(0, 0), (60, 0), (0, 80)]), (None, [(5, 5), (90, 90)])):
        for c, centre in enumerate(centres):
            for _ in range(150 if c else 900):
                i += 1
                rows.append((i, g, float(centre[0] + rng.normal()), float(centre[1] + rng.normal()), 0))
                truth.setdefault((g, c), []).append(i)
    rows += rows[:50] + [(5000, "a", None, 1.0, 0), (5001, "a", math.nan, 1.0, 0), (None, "a", 1.0, 1.0, 0), (7000, "lonely", 3.0, 3.0, 0), (7001, "same", 1.0, 1.0, 0), (7002, "same", 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "sid long, g0 string, p double, q double, id int").repartition(7)
    members, described = similarity_clusters(df, "sid", "g0", ("p", "q"))
    got = {}
    for r in members.collect():
        got.setdefault((r.g, r.cluster), []).append(r.id)
    assert sorted(map(sorted, got.values())) == sorted([*map(sorted, truth.values()), [7000], [7001, 7002]])
    for r in described.collect():
        own = sorted((m.distance, m.id) for m in members.where((F.col("cluster") == r.cluster) & F.col("g").eqNullSafe(F.lit(r.g))).collect())
        assert (r.n, r.rep_id, r.typical) == (len(own), min(m[1] for m in own), [m[1] for m in own[:5]])
    assert similarity_clusters(df.limit(0), "sid", "g0", ("p", "q"))[0].count() == 0


def test_many_groups_take_the_same_clusters(spark, monkeypatch):
    from morphoquarry.llm import clusters

    rows = [(i, f"g{i % 6}", float((i // 6) % 2 * 50 + i % 3), 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, "sid long, g string, p double, q double")
    few = {(r.id, r.cluster) for r in similarity_clusters(df, "sid", "g", ("p", "q"))[0].collect()}
    monkeypatch.setattr(clusters, "BROADCAST_GROUPS", 2)
    monkeypatch.setattr(clusters, "PART_ROWS", 7)
    assert {(r.id, r.cluster) for r in similarity_clusters(df, "sid", "g", ("p", "q"))[0].collect()} == few and len(few) == 120


def test_ward_and_cut():
    x = np.array([[0.0], [1.0], [10.0], [11.5], [30.0]])
    merges = ward(np.ones(5), x)
    assert len(merges) == 4 and {tuple(sorted(m[:2])) for m in merges[:2]} == {(0, 1), (2, 3)}
    assert len(set(cut_tree(np.ones(5), x, clusters=2))) == 2
    assert len(set(cut_tree(np.ones(4), np.array([[0.0], [1.0], [2.0], [3.0]])))) == 1


@pytest.mark.parametrize("k", [2, 61, 150, 300, 700])
def test_many_clusters_are_all_told(k):
    from morphoquarry.llm.clusters import FeatureTree

    rng = np.random.default_rng(k)
    side = math.ceil(math.sqrt(k))
    centres = np.array([(i % side, i // side) for i in range(k)], float)
    x = np.repeat(centres, 40, axis=0) + rng.uniform(-0.06, 0.06, (40 * k, 2))
    truth, order = np.repeat(np.arange(k), 40), rng.permutation(40 * k)
    parts = []
    for part in np.array_split(order, 5):
        tree = FeatureTree(2)
        tree.insert(np.ones(len(part)), x[part], (x[part] ** 2).sum(1))
        parts.append(tree)
    one = FeatureTree(2, max(t.radius for t in parts))
    one.insert(*[np.concatenate([getattr(t, c) for t in parts]) for c in ("count", "total", "square")])
    centre = one.total / one.count[:, None]
    label = cut_tree(one.count, centre, 2 * np.sqrt(np.maximum(one.square / one.count - (centre**2).sum(1), 0)))
    assert len(set(label)) == k
    found = label[((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)]
    assert len(set(zip(found.tolist(), truth.tolist()))) == k


def test_clusters_tighter_than_a_leaf_and_records_alone():
    tight, several = np.array([[0.0], [1.0], [2.0], [3.0]]), np.full(4, 5.0)
    assert len(set(cut_tree(several, tight, np.full(4, 0.01)))) == 4
    assert len(set(cut_tree(np.ones(4), tight, np.zeros(4)))) == 1


# packing


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_places_each_once(case):
    capacity, sizes = case
    histogram = {s: sizes.count(s) for s in set(sizes)}
    placements, containers, _ = plan(histogram, capacity)
    grid, seen = np.zeros((containers, capacity), int), dict.fromkeys(histogram, 0)
    for length, first, items, container, each, offset in placements:
        assert first == seen[length]
        seen[length] += items
        for k in range(items):
            at = offset + k % each * length
            grid[container + k // each, at : at + length] += 1
            assert at + length <= capacity
    assert seen == histogram and grid.max(initial=0) <= 1 and (not containers or grid.any(1).all())
    assert containers <= 11 / 9 * math.ceil(sum(sizes) / capacity) + 4 or containers <= len(sizes)


def test_packed(spark):
    rng = random.Random(9)
    sizes = [rng.choice([5, 5, 5, rng.randrange(1, 130)]) for _ in range(2000)] + [100, 250, 300, 0, None]
    rows = [(i, s, "x") for i, s in enumerate(sizes)]
    out = packed(spark.createDataFrame(rows, "id long, n_tokens long, bin string"), 100).collect()
    lying, held = {}, {}
    for r in out:
        held[r.id] = held.get(r.id, 0) + r.n_tokens
        if r.n_tokens:
            lying.setdefault(r.container, []).append((r.start, r.start + r.n_tokens))
        else:
            assert r.container is None and r.start is None
    assert held == {i: s or 0 for i, s in enumerate(sizes)}
    for spans in lying.values():
        spans.sort()
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert all(sum(r.id == i for r in out) == 1 for i, s in enumerate(sizes[:200]) if s <= 100)
    assert len(lying) <= 1.02 * sum(s or 0 for s in sizes) / 100 + 2
    assert packed(spark.createDataFrame([], "id long, n_tokens long"), 100).count() == 0


def test_measured(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 300_000), (5, "<|endoftext|>"), (None, "lost")], "d long, text string")
    got = {r.id: r.n_tokens for r in measured(df, "d", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1 and None not in got


# leaks

VOCABULARY = ["".join(random.Random(i).choices(string.ascii_lowercase, k=6)) for i in range(4000)]


def text_of(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def brute(doc, item, span=12, one_in=7):
    joined = " " + " ".join(doc) + " "
    if any(" " + " ".join(item[i : i + span]) + " " in joined for i in range(len(item) - span + 1)):
        return True
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(doc):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (v != w)))
        row = new
    return min(row) <= len(item) // one_in


def test_leaks_brute(spark):
    rng = random.Random(7)
    items = [text_of(rng, rng.randrange(14, 90)) for _ in range(12)]
    docs = []
    for d in range(150):
        item, body = rng.choice(items), text_of(rng, rng.randrange(0, 60))
        kind = d % 5
        if kind == 0:
            n = rng.randrange(9, 15)
            at = rng.randrange(max(1, len(item) - n))
            piece = item[at : at + n]
        elif kind in (1, 2):
            piece = list(item)
            for _ in range(rng.randrange(0, len(item) // 7 + 4)):
                at, what = rng.randrange(len(piece)), rng.randrange(3)
                piece[at : at + 1] = [] if what == 0 else [rng.choice(VOCABULARY)] if what == 1 else [piece[at], rng.choice(VOCABULARY)]
        else:
            piece = []
        at = rng.randrange(len(body) + 1)
        docs.append(body[:at] + piece + body[at:])
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute(doc, item)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)] + [(900, None), (901, ""), (None, " ".join(items[0])), (0, " ".join(docs[0]))], "doc long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (52, "two words"), (53, "..."), (0, " ".join(items[0]))], "item long, text string")
    got = {tuple(r) for r in leaks(df, "doc", "text", bench, "item", "text").collect()}
    assert got == want and len(want) > 30
    assert leaks(df.limit(0), "doc", "text", bench, "item", "text").count() == 0 and leaks(df, "doc", "text", bench.limit(0), "item", "text").count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [text_of(rng, 30) for _ in range(9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 2)
    assert {tuple(r) for r in leaks(df, "id", "text", df, "id", "text").collect()} == {(i, i) for i in range(9)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 4), st.integers(0, 5))
def test_winnowing_meets_every_shared_run(seed, gram, window, more):
    rng = np.random.default_rng(seed)
    shared = rng.integers(1, 50, gram + window - 1 + more)
    prints = []
    for _ in range(2):
        codes = np.concatenate([rng.integers(0, 50, rng.integers(0, 20)), shared, rng.integers(0, 50, rng.integers(0, 20))])
        at = runs(codes, gram)
        h = gram_hashes(codes, at, gram)
        prints.append(set(h[winnow(at, h, window)].tolist()))
    assert prints[0] & prints[1]


@pytest.mark.parametrize("n", range(1, 61))
def test_items_of_every_length_with_changes_are_found(n):
    rng = random.Random(n)
    assert sum(fingerprint_shape(n)) - 1 <= least_run(n)
    for trial in range(30):
        item, changes = text_of(rng, n), n // 7
        copy = list(item)
        places = [round((k + 1) * n / (changes + 1)) for k in range(changes)] if trial % 2 else sorted(rng.sample(range(n), changes))
        for at in reversed(places):
            what = trial // 2 % 4 if trial < 16 else rng.randrange(3)
            at = min(at, len(copy) - 1)
            copy[at : at + 1] = [] if what == 1 else ["new", copy[at]] if what == 2 else ["new"]
        doc = text_of(rng, rng.randrange(30)) + copy + text_of(rng, rng.randrange(30))
        known = Items([5], [" ".join(item)])
        got = known.leaked([(1, [known.number.get(w.encode(), 0) for w in doc])])
        assert got == {(1, 5)}, (n, places)


def test_short_items_against_brute():
    rng = random.Random(6)
    few = VOCABULARY[:25]
    items = [[rng.choice(few) for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    docs = [[rng.choice(few) for _ in range(rng.randrange(0, 40))] + rng.choice(items)[rng.randrange(5) :] for _ in range(150)]
    known = Items(list(range(40)), [" ".join(i) for i in items])
    got = known.leaked([(d, [known.number.get(w.encode(), 0) for w in doc]) for d, doc in enumerate(docs)])
    assert got == {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute(doc, item)}


FORMS = [
    "Alpha beta, GAMMA; delta-four 5 epsilon",
    "<p>Alpha <b>be</b>ta</p> gamma\n> delta-\n> four 5 epsilon",
    "1. alpha beta\n2. gamma\n3. delta-four 5\n- epsilon",
    "alpha​ be­ta ｇａｍｍａ delta‑four 5 **epsilon**",
    "alpha&nbsp;beta [gamma](http://x.y) delta'four 5\r\nepsilon",
    "[12:30] user1: alpha beta\n| gamma delta-four\n| 5 epsilon",
]


@pytest.mark.parametrize("text", FORMS)
def test_forms_of_one_text(text):
    assert words(text) == ["alpha", "beta", "gamma", "deltafour", "5", "epsilon"]


def test_line_numbers_have_two_readings():
    assert ["a", "57", "b"] in readings("a\n57. b") and ["a", "b"] in readings("a\n57. b") and ["57", "b"] in readings("| 57. b")
    assert readings(None) == readings("") == [[]]


# subjects


def test_subjects_held_out(spark):
    rng = random.Random(3)
    own = {s: ["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(30)] for s in ("law", "sport", "optics")}
    frames = ["the {} was seen before the {}", "without a {} there is no {}", "we looked at {} and {} again", "nobody had expected {} near {}"]
    plain = ["thanks for the quick reply", "the list is sorted by name", "nothing else has changed", "it took about {} minutes".format("some")]
    docs, truth, labels = [], set(), []
    for d in range(900):
        told = rng.sample(sorted(own), rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(frames).format(*rng.sample(own[s], 2)) for s in told for _ in range(rng.randrange(4, 7))]
        lines += [rng.choice(plain) for _ in range(rng.randrange(0, 4) + (6 if not told else 0))]
        rng.shuffle(lines)
        text = ". ".join(lines) + "."
        docs.append((d, rng.choice(["en", "EN", None]), text, "x"))
        for s in told:
            if sum(any(t in line for t in own[s]) for line in lines) / len(lines) >= 0.25:
                truth.add((d, s))
            if rng.random() < 0.2:
                labels.append((d, s if rng.random() < 0.95 else rng.choice(sorted(own))))
    docs += [(9000, None, None, ""), (9001, "??", "", ""), (9002, "en", "# Heading\nSteps:", ""), (None, "en", docs[0][2], ""), docs[5]]
    df = spark.createDataFrame(docs, "doc long, lang string, text string, id string")
    lab = spark.createDataFrame(labels + [(1, "nonsense"), (None, "law"), (2, None), (77777, "law")], "doc long, subject string")
    got = {tuple(r) for r in subject_areas(df, "doc", "text", "lang", lab, "doc", "subject", sorted(own)).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
    assert subject_areas(df, "doc", "text", "lang", lab.limit(0), "doc", "subject", sorted(own)).count() == 0
    assert subject_areas(df.limit(0), "doc", "text", "lang", lab, "doc", "subject", sorted(own)).count() == 0
    assert subject_areas(df, "doc", "text", "lang", lab, "doc", "subject", []).count() == 0


def test_sentences():
    assert sentences("# Notes\n\nOne here. Two\nis wrapped!\nSteps:\n- Three\n\n4. Four.") == ["One here.", "Two is wrapped!", "Three", "Four."]
    assert sentences("<html><p>A b.</p><p>C <b>d</b></p></html>") == ["A b.", "C d"] and sentences(None) == sentences("...") == []


def test_copies_of_an_item_are_searched_once(spark, monkeypatch):
    text = "seven grey boats left the harbour before noon and nobody on the quay had seen them"
    docs = spark.createDataFrame([(1, f"They say {text} again."), (2, "nothing here"), (1, f"They say {text} again.")], "doc_id long, text string")
    items = spark.createDataFrame([(i, text) for i in range(300)] + [(300, "a quite different item of text that no document holds at all, not in part"), (7, f"They say {text}")], "item_id long, text string")
    held, make = [], Items.__init__
    monkeypatch.setattr(Items, "__init__", lambda self, ids, texts: held.append(len(texts)) or make(self, ids, texts))
    got = [tuple(r) for r in leakage.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()]
    assert sorted(got) == [(1, i) for i in range(300)] and held == [3]
