"""Operators of the object engine on small cases with known results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphoquarry.functions import axes, normalise, special
from morphoquarry.operators import aggregate, filters, geometry, graph, learn, morphology, neighbours, reshape, sets, stats, twostage, windows
from morphoquarry.plans.stages import Stage, ordered, run
from morphoquarry.sources import files, sinks
from morphoquarry.sources.synthetic import example_objects
from morphoquarry.streaming.partials import late_counts


def test_distribution_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and special.t_two_sided(0.0, 5) == 1.0
    assert special.f_sf(4.0, 2, 20) == pytest.approx(0.03457161, abs=1e-7)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and special.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-9)
    assert special.kolmogorov_sf(1.3580986, 1) == pytest.approx(0.05, abs=1e-5)
    assert special.fisher_exact_p(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-7)
    assert special.mann_whitney_p(0, 4, 4, 0) == pytest.approx(2 / 70) and special.mann_whitney_p(8, 4, 4, 0) == 1.0
    assert sum(special._rank_sum_counts(4, 3)) == math.comb(7, 3)


def test_sample_tests():
    w, p = special.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and 0.003 < p < 0.01
    assert math.isnan(special.shapiro_wilk(np.ones(10))[0]) and math.isnan(special.skew_test(np.arange(5))[0])
    z, p = special.skew_test(np.array([1, 2, 3, 4, 5, 6, 7, 8.0]))
    assert z == pytest.approx(0, abs=1e-9) and p == pytest.approx(1)
    assert special.wilcoxon_signed_rank(np.array([1, 2, 3, -4.0]))[0] == 4.0 and math.isnan(special.wilcoxon_signed_rank(np.zeros(3))[1])


def test_thresholds():
    given = {"area": [50, 100], "intensity_mean": [200, 2000], "0": {"area": [20, 200]}, 1: {"intensity_mean": [0, None]}}
    got = filters.spread_thresholds(given, [0, 1, 2])
    assert got[0] == {"area": (20, 200), "intensity_mean": (200, 2000)} and got[1]["intensity_mean"] == (0, None) and got[2]["area"] == (50, 100)


def test_threshold_columns(spark):
    df = spark.createDataFrame([(0, 1.0)], "colocal_id int, area double")
    with pytest.raises(KeyError, match="volume"):
        filters.thresholds_by_id(df, "colocal_id", {0: {"volume": (1, 2)}})
    filters.check_thresholds(df, {0: {"ch3_intensity": (1, 2)}})


def test_filter_objects_ignores_order_of_ids(spark):
    rows = [(1, "e", 0, 1, 5.0, None, None), (2, "e", 0, 2, 50.0, None, None), (3, "e", 3, 1, 5.0, 7, 0.9), (4, "e", 3, 2, 5.0, 7, 0.8), (5, "e", 4, 2, 5.0, 8, 0.5), (6, "e", 4, 3, 5.0, 8, 0.4)]
    df = spark.createDataFrame(rows, "obj_id int, ex_i string, colocal_id int, label int, area double, itx int, share double")
    ranges = {4: {"area": (0, 10)}, 3: {"area": (0, 10)}, 0: {"area": (10, None)}}
    got = filters.filter_objects(df, ranges, {4: [3, 0], 3: [0]}, ["ex_i"], "colocal_id", "label", "itx", "share")
    assert {r.obj_id for r in got.collect()} == {2, 5}
    with pytest.raises(ValueError):
        filters.filter_objects(df, ranges, {4: [3], 3: [4]}, ["ex_i"], "colocal_id", "label", "itx", "share").count()


def test_ranges_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, math.nan), (4, None)], "id int, v double")
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(filters.range_filter(df, {"v": (1.0, None)})) == {2} and ids(filters.range_filter(df, {"v": (1.0, 2.0)}, inclusive=True)) == {1, 2}
    assert ids(filters.range_filter(df, {"v": (None, None)})) == {1, 2, 3, 4} and filters.range_counts(df, {"v": (0.0, 5.0)}).first().post_v == 2
    assert filters.drop_empty_columns(df.withColumn("n", F.lit(None).cast("int"))).columns == ["id", "v"]


def test_inherited_ids(spark):
    table = sets.inherited_ids(sets.spec_table(spark, {3: [1, 2], 4: [0, 1, 2], 5: [0, 2]}))
    assert {tuple(r) for r in table.collect()} == {(3, 2), (4, 2), (5, 2), (4, 3), (4, 5)}


def test_reshape(spark):
    df = spark.createDataFrame([((1, (2.0,)), "x_ch12", "DAPI (405) | Cy5 (6[34]0)", "[1, nan, 2.5]")], "s struct<a int, b struct<c double>>, n string, o string, t string")
    assert reshape.flatten_structs(df).columns == ["s_a", "s_b_c", "n", "o", "t"]
    r = df.select(reshape.channel_suffix(F.col("n")).alias("c"), reshape.channel_options(F.col("o")).alias("o"), reshape.parse_list(F.col("t")).alias("t"), reshape.first_pattern(F.col("n"), {"zz": "no", "ch[0-9]+": None}).alias("p")).first()
    assert (r.c, [tuple(x) for x in r.o], r.t, r.p) == (12, [("DAPI", "405"), ("Cy5", "6[34]0")], [1.0, None, 2.5], "ch12")
    maps = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": None}), (None, {"a": 1})], "o map<string,int>, n map<string,int>")
    assert [x.m for x in maps.select(reshape.merge_maps(F.col("o"), F.col("n")).alias("m")).collect()] == [{"a": 1, "b": 3, "c": None}, {"a": 1}]
    assert [x.s for x in spark.createDataFrame([(0.00005,), (0.02,), (math.nan,), (None,), (0.5,)], "p double").select(reshape.stars(F.col("p")).alias("s")).collect()] == ["****", "*", "", "", "n.s."]


def test_region_properties(spark):
    voxels = spark.createDataFrame([("a", 1, y, x, float(x)) for y in range(2, 6) for x in range(3, 11)], "ex string, label int, y int, x int, v double")
    r = aggregate.region_properties(voxels, ["ex", "label"], ["y", "x"], "v", with_coords=True).first()
    assert (r.area, list(r.centroid), list(r.bbox), r.intensity_mean, len(r.coords)) == (32, [3.5, 6.5], [2, 3, 6, 11], 6.5, 32)
    assert r.axis_major_length == pytest.approx(4 * math.sqrt(63 / 12 + 1 / 12)) and r.eccentricity == pytest.approx(2.0)


VOLUMES = {  # name → (synapses, dendrites, overlap, nearest within 3.4)
    "none": ({1: [(0, 2), (0, 2), (0, 2)]}, {1: [(3, 5), (3, 5), (3, 5)]}, None),
    "one": ({1: [(1, 3)] * 3}, {1: [(1, 4)] * 3}, 1),
    "several": ({1: [(1, 3)] * 3}, {1: [(1, 2), (1, 2), (1, 3)], 2: [(2, 3), (1, 3), (1, 3)], 3: [(1, 2), (2, 3), (1, 3)]}, 2),
    "tie": ({1: [(1, 3)] * 3}, {5: [(1, 2), (1, 3), (1, 3)], 2: [(2, 3), (1, 3), (1, 3)]}, 2),
    "empty": ({1: [(1, 3)] * 3}, {}, None),
}


@pytest.mark.parametrize("case", list(VOLUMES))
def test_overlap_of_volumes(spark, case):
    syn, den, want = VOLUMES[case]
    box = lambda objects: spark.createDataFrame([("v", z, y, x, i) for i, ((z0, z1), (y0, y1), (x0, x1)) in objects.items() for z in range(z0, z1) for y in range(y0, y1) for x in range(x0, x1)], "vol string, z int, y int, x int, label int")
    got = aggregate.best_overlaps(box(syn).withColumnRenamed("label", "syn"), box(den).withColumnRenamed("label", "den"), ["vol", "z", "y", "x"], "syn", "den").collect()
    assert [r.den for r in got] == ([want] if want else [])


def test_nearest_ties_take_the_smaller_id(spark):
    left = spark.createDataFrame([(1, "k", 5.0, 5.0)], "id long, k string, y double, x double")
    right = spark.createDataFrame([(7, "k", 5.0, 3.0), (3, "k", 5.0, 7.0), (4, "k", 50.0, 7.0), (5, "other", 5.0, 5.0)], "id long, k string, y double, x double")
    near = lambda r: [tuple(x) for x in neighbours.nearest_within(left, right, "id", ["y", "x"], ["k"], r).collect()]
    assert near(3.0) == [(1, 3, 2.0)] and near(2.0) == []


@pytest.mark.parametrize("cell_rows", [8, 1000])
def test_nearest_neighbours(spark, cell_rows):
    rng = np.random.default_rng(1)
    pts = [(i, "a" if i % 3 else "b", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30, (200, 2)))] + [(999, "lone", 1.0, 1.0), (998, None, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "id long, k string, x double, y double")
    got = {(r.id, r["rank"]): r.neighbour for r in neighbours.nearest_neighbours(df, "id", [F.col("x"), F.col("y")], [F.col("k")], 4, cell_rows=cell_rows).collect()}
    for i, k, x, y in pts[:200]:
        want = sorted((round((x - b[2]) ** 2 + (y - b[3]) ** 2, 9), b[0]) for b in pts if b[1] == k and b[0] != i)[:4]
        assert [got[i, n + 1] for n in range(4)] == [w[1] for w in want]
    assert (999, 1) not in got and neighbours.nearest_neighbours(df.limit(0), "id", [F.col("x")], [F.col("k")], 2).count() == 0


def test_outlines_hold_the_area(spark):
    cells = {(1, 1), (1, 2), (2, 1), (3, 3), (3, 4), (4, 4)} | {(y, x) for y in range(6, 11) for x in range(6, 11)} - {(8, 8)}
    df = spark.createDataFrame([("e", 1, y, x) for y, x in cells], "ex string, label long, y int, x int")
    rings = [[(p["x"], p["y"]) for p in r.ring] for r in geometry.outlines(df, ["ex"], "label").collect()]
    signed = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2 for r in rings]
    assert len(rings) == 4 and sum(signed) == pytest.approx(len(cells)) and sum(s < 0 for s in signed) == 1 and all(r[0] == r[-1] for r in rings)


def test_polygons(spark):
    vertices = [("s", 2, 4.0, 4.0), ("s", 0, 0.0, 0.0), ("s", 1, 4.0, 0.0), ("s", 3, 0.0, 4.0), ("line", 0, 0.0, 0.0), ("line", 1, 1.0, 1.0), ("line", 2, 2.0, 2.0)]
    ring = geometry.rings_from_vertices(spark.createDataFrame(vertices, "i string, n int, x double, y double"), ["i"], "n", "x", "y")
    assert [r.i for r in ring.collect()] == ["s"] and len(ring.first().ring) == 5
    assert ring.select(geometry.ring_area(F.col("ring")).alias("a")).first().a == 16.0
    assert geometry.area_in_box(ring, "ring", (1.0, 1.0, 3.0, 9.0), "a").first().a == pytest.approx(6.0)
    assert geometry.raster(ring, ["i"], "ring", 1.0).count() == 16


def test_morphology(spark):
    square = spark.createDataFrame([("e", 1, y, x) for y in range(5) for x in range(5)] + [("e", 2, 2, 8)], "ex string, label int, y long, x long")
    size = lambda d, label: d.where(F.col("label") == label).count()
    args = (square, ["ex"], ["y", "x"], "label")
    assert size(morphology.erode(*args), 1) == 9 and size(morphology.outline_places(*args), 1) == 16 and size(morphology.dilate(*args), 1) == 45 and size(morphology.dilate(*args), 2) == 5
    assert size(morphology.shrink(*args, 4), 1) == 9 and size(morphology.shrink(*args, 4), 2) == 1
    two = square.where("x <> 2")
    assert morphology.part_labels(two, ["ex"], ["y", "x"], "label").where("label = 1").select("part").distinct().count() == 2
    slices = spark.createDataFrame([("e", 1, 0, 0, 0), ("e", 7, 1, 0, 0), ("e", 7, 1, 0, 1), ("e", 3, 2, 0, 1), ("e", 1, 2, 5, 5)], "ex string, label int, z long, y long, x long")
    assert morphology.propagate(slices, ["ex"], "label").select("object").distinct().count() == 2
    assert morphology.longest_way(morphology.thinned({(0, x) for x in range(10)})) == 9.0
    assert morphology.longest_way({(i, i) for i in range(5)}) == pytest.approx(4 * 2**0.5)
    loop = lambda y, x, h, w: {(y + i, x + j) for i in range(h) for j in range(w) if i in (0, h - 1) or j in (0, w - 1)}
    for shape in (loop(0, 0, 7, 9), loop(0, 0, 7, 9) | loop(6, 8, 9, 5), loop(0, 0, 7, 9) | {(20, x) for x in range(3)}):
        place = {p: i for i, p in enumerate(sorted(shape))}
        d = [[0.0 if p == q else math.dist(p, q) if max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 else math.inf for q in place] for p in place]
        for k in range(len(d)):
            d = [[min(d[i][j], d[i][k] + d[k][j]) for j in range(len(d))] for i in range(len(d))]
        assert morphology.longest_way(shape) == pytest.approx(max(x for row in d for x in row if x < math.inf))
    values = spark.createDataFrame([("a", v) for v in [1.0] * 50 + [9.0] * 50] + [("b", 3.0)], "k string, v double")
    cut = {r.k: r.threshold for r in morphology.otsu(values, ["k"], "v").collect()}
    assert 1.0 < cut["a"] < 9.0 and cut["b"] == 3.0


def test_flood(spark):
    rows = [("e", 0, x, float(h), s) for x, (h, s) in enumerate([(0, 5), (1, None), (9, None), (1, None), (0, 6)])]
    got = {r.x: r.basin for r in morphology.flood(spark.createDataFrame(rows, "ex string, y int, x int, v double, seed int"), ["ex"], ["y", "x"], "v", "seed").collect()}
    assert got[1] == 5 and got[3] == 6 and len(got) == 5


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {i: i for e in edges for i in e if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in parent], "id long")
    assert {r.id: r.component for r in graph.connected_components(df, nodes).collect()} == {i: find(i) for i in parent}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_network():
    import pandas as pd

    path = pd.DataFrame({"src": [1, 2, 3, 10], "dst": [2, 3, 4, 11], "weight": [1.0] * 4})
    nodes, whole = graph.network_of(path, 2)
    assert whole["nodes"] == 6 and whole["clustering"] == 0 and whole["path_length"] == pytest.approx(10 / 6)
    by = nodes.set_index("node")
    assert by.betweenness[2] == pytest.approx(2 / 20 * 2) and by.core.max() == 1
    triangles = pd.DataFrame({"src": [1, 2, 1, 4, 5, 4, 3], "dst": [2, 3, 3, 5, 6, 6, 4], "weight": [1.0] * 7})
    nodes, whole = graph.network_of(triangles, 0)
    assert nodes.set_index("node").module[[1, 2, 3]].nunique() == 1 and nodes.module.nunique() == 2 and whole["modularity"] == pytest.approx(6 / 7 - 0.5)


def test_windows(spark):
    df = spark.createDataFrame([(1, "a", 0.01), (2, "a", 0.02), (3, "a", 0.03), (4, "a", 0.5), (5, "a", None), (6, "a", math.nan), (7, "b", 0.4)], "id int, k string, p double")
    q = {r.id: r.q for r in windows.adjusted(df, "p", ["k"]).collect()}
    assert [q[i] for i in (1, 2, 3, 4)] == pytest.approx([0.04, 0.04, 0.04, 0.5]) and q[5] is None and q[6] is None and q[7] == 0.4
    assert {r.id: r.q for r in windows.adjusted(df, "p", ["k"], "bonferroni").collect()}[4] == 1.0
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, v double")
    assert [r.z for r in windows.zscore(same, "v", ["k"], zero_if_constant=True).collect()] == [0.0, 0.0]


def test_statistics_edges(spark):
    df = spark.createDataFrame([("v", "a", 1.0), ("v", "b", 2.0), ("w", "a", 3.0), ("w", "a", 3.0), ("w", "b", 3.0), ("w", "b", 3.0)], "k string, g string, x double")
    t = {r.k: r for r in stats.with_t_p(stats.two_samples(df, ["k"], "g", "a", "b", "x")).collect()}
    assert t["v"].t_student is None and t["w"].t_student is None and t["w"].p_welch is None
    assert {r.k: (r.u, r.p) for r in stats.mann_whitney(df, ["k"], "g", "a", "b", "x").collect()}["w"] == (2.0, 1.0)
    assert stats.anova(df.limit(0), ["k"], "g", "x").count() == 0 and stats.mann_whitney(df.limit(0), ["k"], "g", "a", "b", "x").count() == 0
    x = spark.createDataFrame([(float(i), float(2 * i + (-1) ** i)) for i in range(50)], "a double, b double")
    vif = {r.feature: r.vif for r in stats.variance_inflation(x, ["a", "b"]).collect()}
    a, b = np.arange(50.0), 2 * np.arange(50.0) + (-1.0) ** np.arange(50)
    assert vif["a"] == pytest.approx(1 / (1 - (a @ b) ** 2 / ((a @ a) * (b @ b))), rel=1e-6)


def test_random_intercepts(spark):
    rng = np.random.default_rng(0)
    rows = [(s, float(x), float(3 + 2 * x + effect + rng.normal(0, 0.5))) for s, effect in enumerate(rng.normal(0, 2, 200)) for x in rng.normal(0, 1, rng.integers(2, 9))]
    got = {r.term: r.estimate for r in stats.random_intercept_model(spark.createDataFrame(rows, "s int, x double, y double"), "s", "y", ["x"]).collect()}
    assert got["x"] == pytest.approx(2, abs=0.1) and got["var_subject"] == pytest.approx(4, rel=0.3) and got["var_residual"] == pytest.approx(0.25, rel=0.2)


def test_learning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" if i % 2 else None, float(c + rng.normal(0, 0.1)), float(rng.normal())) for i, c in enumerate([0.0, 5.0, 10.0] * 60)]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double")
    assert learn.one_hot(df, "g").agg(F.sum("g_x")).first()[0] == 90
    for fit in (lambda d: learn.kmeans(d, ["a"], 3)[0], lambda d: learn.clara(d, ["a"], 3, "id", sample=60, repeats=2)[0]):
        sizes = [r["count"] for r in fit(df).groupBy("cluster").count().collect()]
        assert sizes == [60, 60, 60]
    out, parts, shares = learn.principal_components(learn.standard_scaled(df, ["a", "b"]), ["a", "b"], 1)
    assert len(parts) == 1 and 0.5 <= shares[0] < 0.7 and "pc1" in out.columns and "pc2" not in out.columns
    assert {r.g: r.n for r in learn.within_groups(df, "g", lambda d: d.groupBy("g").agg(F.count("*").alias("n"))).collect()} == {None: 90, "x": 90}
    labelled = df.withColumn("y", (F.col("a") > 4).cast("string"))
    gain = {r.feature: r.importance for r in learn.permutation_importance(labelled, ["a", "b"], "y", "id", trees=5).collect()}
    assert gain["a"] > 0.2 > abs(gain["b"])


def test_stage_order():
    stage = lambda n, **k: Stage(n, lambda t: {}, **k)
    line = [stage("C"), stage("A", before=("C",)), stage("B", after=("A",)), stage("D", before=("A",))]
    assert [s.name for s in ordered(line)] == ["D", "A", "B", "C"]
    with pytest.raises(ValueError):
        ordered([stage("A", after=("B",)), stage("B", after=("A",))])
    with pytest.raises(KeyError, match="A needs x; B needs y"):
        run([stage("B", needs=("y",), after=("A",)), stage("A", needs=("x",))], {})


def test_blocked_compile():
    made = Stage("a", lambda t: {"t": 1}, lambda t: {"a": 1})
    other = Stage("b", lambda t: {}, lambda t: {"b": t["t"]}, after=("a",), blocks=("a",))
    assert run([other, made], {})[1] == {"b": 1}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.json": '{"x": 1}', "b.json": "{", "empty.csv": "", "data.csv": "k,v\n1,2\n"}.items():
        (tmp_path / "in" / name).write_text(text)
    np.save(tmp_path / "in" / "p.npy", np.array([[[0, 1], [2, 0]], [[0, 0], [0, 3]]]))
    folder = str(tmp_path / "in")
    listed = files.matching(files.listing(spark, folder), regex=r"^[^.]")
    assert {r.name for r in files.matching(listed, regex=r"json$").collect()} == {"a.json", "b.json"} and files.most_recent(listed).count() == 1
    status = files.progress(listed, F.lit("e1"), ["a.json", ["x.csv", "data.csv"]]).first()
    assert (status.n_files, status.status) == (5, "ready")
    records = {r.path.rsplit("/")[-1]: (r.record, r.error) for r in files.read_records(spark, folder).collect()}
    assert records["a.json"] == ('{"x": 1}', None) and records["b.json"][0] is None and "JSONDecodeError" in records["b.json"][1]
    assert files.read_csv_tables(spark, folder, {"empty": "k int, v int"})["empty"].count() == 0 and files.read_csv_tables(spark, folder, {"data": "k int, v int"})["data"].first().v == 2
    assert {tuple(r)[1:] for r in files.read_arrays(spark, folder, "ZYX").collect()} == {(0, 0, 1, 1.0), (0, 1, 0, 2.0), (1, 1, 1, 3.0)}
    nine = spark.range(9).withColumnRenamed("id", "z")
    for text in ("2:7:2", "-3:", ":", "4", "::-2", None):
        want = np.arange(9)[files.slice_of(text)]
        assert sorted(r.z for r in nine.where(files.in_slice("z", text, 9)).collect()) == sorted(np.atleast_1d(want).tolist())


def test_trees_and_features(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"msg": [{"id": 1, "name": "r", "acronym": "R", "children": [{"id": 2, "name": "c", "acronym": "C", "children": []}]}]}))
    assert {(r.id, r.parent, r.st_level) for r in files.read_tree(spark, str(tmp_path / "t.json")).collect()} == {(1, None, 1), (2, 1, 2)}
    paths = files.tree_from_paths(spark.createDataFrame([(9, "/1/5/9/"), (1, "/1/")], "id long, structure_id_path string"))
    assert {(r.id, r.parent, r.st_level) for r in paths.collect()} == {(9, 5, 3), (1, None, 1)}
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4))]
    df = spark.createDataFrame([("n", ring, None)], "name string, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    sinks.write_features(df, str(tmp_path / "g"), properties=["name"])
    back = files.read_features(spark, str(tmp_path / "g")).first()
    assert back.name == "n" and len(back.ring) == 4 and back.holes is None
    assert sinks.merged_metadata({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": None, "e": 4}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 4}


def test_resumed_parts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "ex_i string, v int")
    target = str(tmp_path / "parts")
    sinks.write_parts(df, target)
    sinks.write_parts(df.where("ex_i = 'a'").withColumn("v", F.lit(7)), target)
    assert {(r.ex_i, r.v) for r in spark.read.parquet(target).collect()} == {("a", 7), ("b", 2)}
    assert [r.ex_i for r in sinks.left_to_do(spark.createDataFrame([("a",), ("c",)], "ex_i string"), spark.read.parquet(target)).collect()] == ["c"]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("MQ_HOME", "/data")
    (tmp_path / "c.json").write_text('{"a": ["${MQ_HOME}/x"]}')
    assert files.read_config(str(tmp_path / "c.json")) == {"a": ["/data/x"]}
    pytest.importorskip("yaml")
    (tmp_path / "c.yml").write_text("a: !ENV MQ_HOME\nb: !!python/tuple [1, 2]\n")
    assert files.read_config(str(tmp_path / "c.yml")) == {"a": "/data", "b": (1, 2)}


def test_axes():
    shapes = {(3, 23, 1024, 1024): "CZYX", (23, 3, 1024, 1024): "ZCYX", (1, 1, 23, 3, 1024, 1024): "STZCYX", (1024, 1024, 4): "YXC", (1024, 1024, 5): "YXZ", (3, 1024, 1024): "CYX"}
    assert {s: axes.estimate_format(s) for s in shapes} == shapes
    assert axes.to_canonical("YXC") == [2, 0, 1] and axes.without("CZYX", "C") == "ZYX" and axes.unit_factor({"X": 0.5, "Y": 0.5, "Z": 9.0}, "YX") == 0.25
    assert axes.greedy_pairs([1.0, 2.0, 9.0], [2.1, 0.5]) == [(0, 1), (1, 0)]


def test_normalise(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 5.0), ("b", None)], "k string, v double")
    r = normalise.match_mean(normalise.min_max(df, "v", ["k"], "m"), "v", ["k"], 10.0, "t").withColumn("b", normalise.to_bits(F.col("v") / 10, 8)).collect()
    assert {x.p for x in normalise.percentile_norm(df, "v", ["k"], "p", 0.0, 1.0).collect()} == {0.0, 1.0, None}
    assert sorted((x.m, x.b, x.t) for x in r if x.m is not None) == [(0.0, 0, 0.0), (0.0, 128, 10.0), (1.0, 255, 20.0)]


def test_generator_and_stream(spark, tmp_path):
    df = example_objects(spark, 4000, 1)
    assert df.count() == 4000 and 0.3 < df.where("colocal_id = 1").count() / 4000 < 0.4
    times = spark.sql("SELECT timestamp_seconds(s) AS ts, 'k' AS k FROM VALUES (0), (30), (61), (1000) t(s)")
    times.write.parquet(str(tmp_path / "s"))
    stream = late_counts(spark.readStream.schema(times.schema).parquet(str(tmp_path / "s")), "ts", ["k"], "1 minute", "1 minute")
    q = stream.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.n for r in spark.table("late").collect()} == {2, 1}


@pytest.mark.parametrize("kind", ["smooth", "ties", "few"])
def test_two_stage(spark, kind):
    rng = np.random.default_rng(3)
    values = {"smooth": rng.normal(size=3000), "ties": rng.integers(0, 6, 3000).astype(float), "few": np.array([4.0, 1.0, 7.0])}[kind]
    rows = [("hot" if i % 5 else None, float(v), i) for i, v in enumerate(values)] + [("hot", None, 9001), ("hot", math.nan, 9002)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    got = {r.k: r.q for r in twostage.percentiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.975, 1.0], "q").collect()}
    clean = df.where("v IS NOT NULL AND NOT isnan(v)")
    ranks = {r.i: (r["rank"], r._ties) for r in twostage.ranked(clean, ["k"], "v").collect()}
    for k in ("hot", None):
        own = np.array([r[1] for r in rows[:-2] if r[0] == k])
        assert got[k] == pytest.approx(np.quantile(own, [0.0, 0.1, 0.5, 0.975, 1.0]), abs=1e-12)
        for _, v, i in [r for r in rows[:-2] if r[0] == k][:200]:
            assert ranks[i] == ((own < v).sum() + ((own == v).sum() + 1) / 2, (own == v).sum())
    order = [r.n for r in twostage.shuffled_rank(df, ["k"], ["i"], 1, "n").where("k = 'hot'").collect()]
    assert sorted(order) == list(range(1, len(order) + 1))
    assert twostage.percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    whole = twostage.with_percentiles(clean, [], "v", [0.5], "q").first()
    assert whole.q[0] == pytest.approx(np.median(values))


def test_normality_of_large_and_null_groups(spark):
    rng = np.random.default_rng(4)
    groups = {"big": rng.gamma(3.0, size=6000).round(2), None: rng.normal(size=40), "five": np.array([1, 2, 2, 5, 9.0]), "flat": np.ones(9), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("five", None)], "k string, v double")
    got = {r.k: r for r in stats.shapiro_by_group(df, ["k"], "v").collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(x) for k, x in groups.items()}
    for k, x in groups.items():
        want = [*special.shapiro_wilk(x), *special.skew_test(x)]
        for g, w in zip([got[k].w, got[k].p_normal, got[k].skew_z, got[k].p_skew], want):
            assert (g is None and math.isnan(w)) or g == pytest.approx(w, rel=1e-6, abs=1e-12)
    assert got["big"].w is not None and got["big"].skew_z > 10 and got[None].w is not None
    # W of the first groups by the definition, coefficients written out
    m = np.array([special._NORMAL.inv_cdf((i - 0.375) / 6000.25) for i in range(1, 6001)])
    assert got["big"].w == pytest.approx(np.corrcoef(m, np.sort(groups["big"]))[0, 1] ** 2, abs=2e-3)
