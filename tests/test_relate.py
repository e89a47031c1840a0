"""Colocalisation, region assignment, stages, label sets and clipping on NULLs, ties, repeats and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from morphoquarry.operators import colocalize as c
from morphoquarry.operators import relate as o
from morphoquarry.operators import runs as r
from morphoquarry.operators.assign import Regions, assign_regions
from morphoquarry.operators.geometry import area_in_box
from morphoquarry.plans.stages import Stage, ordered, run
from morphoquarry.session import Cut

RUNS = "ex string, id long, c int, row long, lo long, hi long"
RING = "array<struct<x:double,y:double>>"
BOX = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def solid(ex, i, ch, y, x, h, w):
    return [(ex, i, ch, row, x, x + w - 1) for row in range(y, y + h)]


def test_overlap_colocalize(spark):
    rows = [
        *solid("a", 1, 0, 0, 0, 10, 10), *solid("a", 2, 1, 0, 0, 5, 4), *solid("a", 3, 1, 5, 0, 5, 4), *solid("a", 4, 2, 0, 2, 10, 4),
        *solid("a", 5, 0, 50, 50, 3, 3), *solid("a", 6, 1, 0, 9, 40, 1), *solid("b", 7, 1, 0, 0, 10, 10), *solid("a", 8, None, 0, 0, 10, 10),
    ]
    runs = spark.createDataFrame(rows, RUNS)
    got = {(g.assign, g.base): (g.partners, round(g.share, 6)) for g in c.overlap_colocalize(runs, [c.Composite((1, 0), 3), c.Composite((2, 1, 0), 4)]).collect()}
    # objects 2 and 3 share 20 pixels each with object 1: the smaller id wins; with channel 2 it shares columns 2 and 3
    assert got == {(3, 1): ({1: 2}, 0.2), (4, 1): ({2: 4, 1: 2}, 0.1)}
    assert c.overlap_colocalize(runs, [c.Composite((1, 0), 3)], threshold=0.2).count() == 0
    union = c.overlap_colocalize(runs, [c.Composite((1, 0), 3)], metric=c.share_of_union).first()
    assert union.share == pytest.approx(20 / 100)
    assert c.overlap_colocalize(runs.limit(0), [c.Composite((1, 0), 3)]).count() == c.overlap_colocalize(runs, []).count() == 0


def test_distance_colocalize_and_composites(spark):
    rows = [(1, 2, "a", 0.0, 0.0), (2, 1, "a", 3.0, 4.0), (3, 1, "a", -3.0, 4.0), (4, 0, "a", 0.0, 1.0), (5, 2, "a", 100.0, 0.0), (6, 1, "a", 110.0, 0.0), (7, 2, None, 0.0, 0.0), (8, 1, "a", None, 0.0)]
    df = spark.createDataFrame(rows + rows[:1], "oid long, ch long, ex string, x double, y double").distinct()
    specs = [c.Composite((1, 2), 3), c.Composite((0, 1, 2), 4)]
    found = c.distance_colocalize(df, specs, "oid", "ch", ["x", "y"], ["ex"], 10.0)
    got = {(g.assign, g.base): (g.partners, g.mean_distance) for g in found.collect()}
    assert got == {(3, 1): ({1: 2}, 5.0), (4, 1): ({0: 4, 1: 2}, 3.0)}  # a tie goes to id 2; exactly 10 apart doesn't count
    assert {g.base for g in c.distance_colocalize(df, specs[:1], "oid", "ch", ["x", "y"], ["ex"], 10.0, pixel_size=2.0).collect()} == set()
    both = c.with_composites(df, found.withColumn("share", F.col("mean_distance")), "oid", "ch")
    assert both.count() == df.count() + 2 and {(b.oid, b.ch) for b in both.where("share IS NOT NULL").collect()} == {(1, 3), (1, 4)}
    assert c.distance_colocalize(df.limit(0), specs, "oid", "ch", ["x", "y"], ["ex"], 10.0).count() == 0


def test_place_of(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0, 0, 4, 4]), (None, [0, 2, 4, 6]), (None, None), (None, [0, 0, 0, 2, 4, 6])], "centroid array<double>, bbox array<long>")
    assert [x.p for x in df.select(c.place_of(F.col("centroid"), F.col("bbox")).alias("p")).collect()] == [[1.0, 2.0], [2.0, 4.0], None, [1.0, 2.0, 3.0]]


def test_assign_regions(spark):
    polys = [(1, "a", 1, 0, BOX(0.0, 0.0, 2.0, 2.0), None), (2, "a", 1, 1, BOX(2.0, 2.0, 2.0, 2.0), []), (3, "a", 2, 0, BOX(2.0, 2.0, 2.0, 2.0), None), (4, "a", 3, 0, BOX(4.0, 4.0, 2.0, 2.0), [BOX(4.5, 4.5, 1.0, 1.0)]), (5, "a", 9, 0, None, None)]
    points = [(1, "a", 1.5, 1.5), (2, "a", 3.0, 3.0), (3, "a", 5.0, 5.0), (4, "a", 99.0, 3.0), (5, "b", 1.0, 1.0), (6, None, 1.0, 1.0), (7, "a", None, 1.0)]
    t = Regions(spark.createDataFrame(points, "pid long, ex string, x double, y double"), spark.createDataFrame(polys, f"poly_id long, ex string, label long, sub_idx int, ring {RING}, holes array<{RING}>"), "pid", "ex")
    got = {p.pid: p for p in assign_regions(t, ["Centroid", "Masking", "Distance"]).collect()}
    assert [(got[i].roi_i_byCentroid, got[i].roi_polyi_byCentroid) for i in range(1, 8)] == [(1, 1), (1, 2), (0, -1), (0, -1), (0, -1), (0, -1), (0, -1)]
    assert got[4].roi_i_byDistance == 3 and got[4].roi_distance == pytest.approx(math.hypot(93, 1)) and got[1].roi_distance == 0
    assert got[3].roi_distance == pytest.approx(0.5) and got[5].roi_distance is None and got[5].roi_polyi_byDistance == -1
    with pytest.raises(KeyError):
        assign_regions(t, ["Atlas"])


def test_nearest_objects_at_any_distance(spark):
    rows = [*solid("a", 1, 0, 0, 0, 2, 2), *solid("a", 2, 0, 0, 5, 2, 2), *solid("a", 3, 0, 3000, 0, 2, 2), *solid("b", 4, 0, 0, 0, 1, 1)]
    got = {g.id: (g.other, g.d) for g in r.nearest(spark.createDataFrame(rows, RUNS).drop("c"), Cut(spark)).collect()}
    assert got == {1: (2, 4.0), 2: (1, 4.0), 3: (1, 2999.0)}


def test_stage_order_and_needs():
    keep = lambda t: {}
    stages = [Stage("A", keep, before=("C",)), Stage("B", keep, after=("A",)), Stage("C", keep), Stage("D", keep, before=("A",))]
    assert [s.name for s in ordered(stages)] == ["D", "A", "B", "C"]
    with pytest.raises(ValueError):
        ordered([Stage("A", keep, after=("B",)), Stage("B", keep, after=("A",))])
    with pytest.raises(KeyError):
        run([Stage("A", keep, needs=("x", "y"))], {})


def test_labels_places_and_scaffolds(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", None, 4.0), ("b", 1, 5.0)], "ex string, label long, v double")
    kept = spark.createDataFrame([("a", 1), ("a", 1), ("c", 2), ("a", None)], "ex string, label long")
    assert sorted(x.label for x in o.keep_labels(df, ["ex"], "label", kept).collect()) == [0, 0, 0, 1]
    places = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "y long, x long")
    assert o.without_places(places, spark.createDataFrame([(1, 2), (None, 3)], "y long, x long"), ["y", "x"]).count() == 2
    rows = spark.createDataFrame([("a", None, 0, 2.0), ("a", 1, 1, 4.0), ("a", 1, 1, None), (None, 1, 1, 9.0)], "ex string, roi long, ch long, v double")
    got = {(x.roi, x.ch): (x.v, x.n) for x in o.scaffold_means(rows, ["ex"], "roi", "ch", "v").collect()}
    assert got == {(0, 0): (2.0, 1), (0, 1): (0.0, 0), (1, 0): (0.0, 0), (1, 1): (4.0, 1)}
    assert o.scaffold_means(rows.limit(0), ["ex"], "roi", "ch", "v").count() == 0
    merged = o.merge_results(spark.createDataFrame([("x", 1)], "k string, n int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, n int"), ["k"])
    assert sorted((m.k, m.n_left, m.n_right) for m in merged.collect()) == [("x", 1, 2), ("y", None, 3)]


def test_texts_of_paths(spark):
    df = spark.createDataFrame([("/d/a/x7.tar.gz",), ("c:\\d\\img0012345",), ("plain",), (None,)], "p string")
    parts = o.path_parts(F.col("p"))
    got = [tuple(x) for x in df.select(*[v.alias(k) for k, v in parts.items()], o.padded_number(F.col("p")).alias("n")).collect()]
    assert got == [("/d/a", "x7.tar", ".gz", "0007"), ("c:/d", "img0012345", "", "0012345"), ("", "plain", "", None), (None, None, None, None)]


def test_covered_counts_each_pixel_once(spark):
    rng = random.Random(2)
    base = [*solid("a", 1, 0, 0, 0, 20, 20), *solid("a", 2, 0, 100, 100, 3, 3)]
    others = [x for i in range(10, 22) for x in solid("a", i, 1, rng.randrange(-5, 20), rng.randrange(-5, 20), rng.randrange(1, 9), rng.randrange(1, 9))]
    got = {g.id: (g.inside, g.outside) for g in o.covered(*[spark.createDataFrame(x, RUNS).drop("c") for x in (base, others)]).collect()}
    pixels = {(x[3], col) for x in others for col in range(x[4], x[5] + 1)}
    inside = sum((y, x) in pixels for y in range(20) for x in range(20))
    assert got == {1: (inside, 400 - inside), 2: (0, 9)}


def test_area_in_box_against_pixels(spark):
    rng = random.Random(4)
    rings = [[(50 + 60 * math.cos(2 * math.pi * k / 9) * rng.uniform(0.4, 1), 40 + 60 * math.sin(2 * math.pi * k / 9) * rng.uniform(0.4, 1)) for k in range(9)] for _ in range(6)]
    rings += [BOX(-10.0, -10.0, 20.0, 20.0), BOX(200.0, 0.0, 5.0, 5.0), [(0.0, 0.0), (1.0, 1.0)], BOX(10.0, -50.0, 5.0, 300.0)[::-1]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rings)] + [(99, None)], f"id long, ring {RING}")
    got = {x.id: x.a for x in area_in_box(df, "ring", (0.0, 0.0, 100.0, 80.0), "a").collect()}
    assert got[99] is None and got[6] == pytest.approx(100) and got[7] == got[8] == 0 and got[9] == pytest.approx(400)

    def inside(ring, x, y):
        return sum((a[1] <= y) != (b[1] <= y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2

    for i in range(6):
        count = sum(inside(rings[i], x + 0.5, y + 0.5) for x in range(100) for y in range(80))
        assert got[i] == pytest.approx(count, rel=0.02, abs=20)
