"""The general operators on NULLs, ties, repeated rows, empty tables and clashing names, against brute force."""

import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphoquarry.functions.units import close_enough, parse_notes, parse_scaling, split_unit
from morphoquarry.operators.flatten import apply_schema, tagged, write_tables
from morphoquarry.operators.hierarchy import closure, hierarchy
from morphoquarry.operators.kdsplit import fit, local_pairs
from morphoquarry.operators.proximity import containing_polygons, near_pairs
from morphoquarry.operators.salted import Measure, merge, partials, salted_aggregate
from morphoquarry.operators.unify import CommonUnits
from morphoquarry.plans.p5 import TREE

POINT = "oid long, k string, x double, y double, g1 long, cell string"


def pairs_of(spark, rows, radius=1.0, cell_rows=8):
    df = spark.createDataFrame(rows, POINT)
    return {(r.id_a, r.id_b) for r in near_pairs(df, "oid", [F.col("x"), F.col("y")], [F.col("k")], radius, cell_rows=cell_rows).collect()}


def test_near_pairs_brute(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("ab"), rng.randrange(60) / 4, rng.randrange(60) / 4, 5, "z") for i in range(400)]
    rows += rows[:30] + [(900, None, 1.0, 1.0, 0, ""), (901, "hot", None, 1.0, 0, ""), (902, "hot", math.nan, 1.0, 0, ""), (903, "hot", math.inf, 1.0, 0, ""), (None, "hot", 1.0, 1.0, 0, "")]
    want = {(a[0], b[0]) for a in rows[:400] for b in rows[:400] if a[0] < b[0] and a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 1.0}
    assert pairs_of(spark, rows) == want and len(want) > 500


def test_near_pairs_empty_and_one_place(spark):
    assert pairs_of(spark, []) == set()
    same = [(i, "a", 2.0, 2.0, 0, "") for i in range(40)]
    assert len(pairs_of(spark, same)) == 40 * 39 // 2


def test_near_pairs_on_sphere(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 180.0, 0.0), (4, -180.0, 0.5), (5, 10.0, 89.9), (6, -170.0, 89.9)], "id long, lon double, lat double")
    got = {tuple(r) for r in near_pairs(df, "id", [F.col("lon"), F.col("lat")], [F.lit(1)], 112.0, sphere=6371.0).collect()}
    assert got == {(1, 2), (3, 4), (5, 6)}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(0, 3)), max_size=60), st.integers(0, 3))
def test_local_pairs(points, radius):
    import numpy as np

    xyz = np.array(points, float).reshape(-1, 3)
    i, j = local_pairs(xyz, radius, leaf=3)
    got = sorted(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist()))
    want = sorted((a, b) for a in range(len(xyz)) for b in range(a + 1, len(xyz)) if ((xyz[a] - xyz[b]) ** 2).sum() <= radius * radius)
    assert got == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=80))
def test_points_have_one_home(points):
    import numpy as np

    key, xyz = np.array([p[0] for p in points]), np.array([[p[1], 0.0] for p in points], float)
    tree = fit(key, xyz, 3)
    rows, cells = tree.route(key, xyz, xyz)
    assert sorted(rows.tolist()) == list(range(len(points)))
    wide, wide_cells = tree.route(key, xyz - 2, xyz + 2)
    assert set(zip(rows.tolist(), cells.tolist())) <= set(zip(wide.tolist(), wide_cells.tolist()))


def test_containing_polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    hole = ring((4, 4), (4, 6), (6, 6), (6, 4), (4, 4))
    polys = [(1, "e", square, None), (1, "e", square, None), (2, "e", square, [hole]), (3, "e", ring((1, 1), (2, 2)), None), (4, "e", None, None), (5, "f", square, []), (6, "e", ring((5, 5), (20, 5), (20, 20)), [None]), (None, "e", square, None), (7, None, square, None)]
    pts = [(1, "e", 5.1, 5.05), (1, "e", 5.1, 5.05), (2, "e", 1.0, 9.0), (3, "e", 30.0, 5.0), (4, "f", 5.0, 5.0), (5, None, 5.0, 5.0), (6, "e", None, 5.0), (7, "e", math.nan, 1.0)]
    kind = "array<struct<x:double,y:double>>"
    p = spark.createDataFrame(pts, "id long, ex string, x double, y double")
    q = spark.createDataFrame(polys, f"pid long, ex string, ring {kind}, holes array<{kind}>")
    run = lambda a, b: {tuple(r) for r in containing_polygons(a, "id", F.col("x"), F.col("y"), [F.col("ex")], b, "pid", "ring", "holes", [F.col("ex")], cell_rows=8).collect()}
    assert run(p, q) == {(1, 1), (1, 6), (2, 1), (2, 2), (4, 5)}
    assert run(p.limit(0), q) == set() and run(p, q.limit(0)) == set()


SCALINGS = {
    "{'X': '2.5E-07 m', 'Y': '1E-07 m', 'Z': None}": {"X": (2.5e-07, "m", False), "Y": (1e-07, "m", False)},
    "X: 0,125 um | Y: 0,25 um": {"X": (0.125, "um", False), "Y": (0.25, "um", False)},
    "80 nm/px (XY), 370 nm/slice (Z)": {"X": (80.0, "nm", False), "Y": (80.0, "nm", False), "Z": (370.0, "nm", False)},
    "9 px/um in X and Y; Z-step 0.3 um": {"X": (9.0, "um", True), "Y": (9.0, "um", True), "Z": (0.3, "um", False)},
    "0.2 x 0.3 um (X x Y)": {"X": (0.2, "um", False), "Y": (0.3, "um", False)},
    '{"X": {"value": 1e-4, "unit": "mm"}, "Y": {"value": null}}': {"X": (1e-4, "mm", False)},
    "unknown": {}, "": {}, None: {}, "{broken": {}, '{"X": NaN}': {},
}


@pytest.mark.parametrize("text", list(SCALINGS), ids=str)
def test_scaling_texts(text):
    assert parse_scaling(text) == SCALINGS[text]


def test_unit_spellings():
    assert split_unit(" sq. Micron") == ("micron", 2) and split_unit("Kubikmikrometer") == ("mikrometer", 3) and split_unit("µm²") == ("um", 2)
    assert close_enough("nm", "mm") is None and close_enough("micormeter", "micrometer") == 0.5 and close_enough("millimeter", "micrometer") is None
    assert parse_notes("Gap of 2 mm. | Areas were exported in square microns.; Centroids are in nm") == ("square microns", "nm")
    assert parse_notes("Section thickness 40 um") == (None, None) and parse_notes(None) == (None, None)


def test_common_units(spark):
    meta = "struct<scaling string>"
    ex = spark.createDataFrame([("a", "YX", ("X=0.5um; Y=0.5um",), None, None, 1), ("b", "ZYX", ("{'X': 1.0, 'Y': 1.0}",), "um", "Sizes were exported in cubic microns.; Centroids are in microns", 2), ("c", None, None, None, None, 3)], f"ex_i string, spatial_axes string, image_metadata {meta}, px_sizes_unit string, notes string, x_pm int")
    rows = [(1, "a", 4.0, "px", [1.0, 2.0], "px"), (1, "a", 4.0, "px", [1.0, 2.0], "px"), (2, "a", 4.0, "micormeter^2", [1.0, 2.0], "nm"), (3, "a", -1.0, "um2", None, None), (4, "a", math.nan, "um2", [1.0, None], "nm"), (5, "b", 2.0, None, [1.0, 2.0, 3.0], None), (6, "b", 2.0, "voxels", [math.nan, 1.0, 1.0], "um"), (7, "zz", 2.0, "um2", [1.0, 1.0], "um"), (8, None, 2.0, "?", [], "??"), (9, "c", 1.0, "um2", None, "")]
    obj = spark.createDataFrame(rows, "obj_id long, ex_i string, area double, area_unit string, centroid array<double>, centroid_unit string").withColumn("a_pm", F.lit("clash"))
    units = CommonUnits(obj, ex)
    got = {r.obj_id: (r.area, r.centroid) for r in units.objects().collect()}
    assert got[1] == (1000.0, None) and got[2] == (4000.0, [1.0, 2.0]) and got[3] == (None, None) and got[4] == (None, None)
    assert got[5] == (2000.0, [1000.0, 2000.0, 3000.0]) and got[6] == (None, None) and got[7] == (None, [1000.0, 1000.0]) and got[8] == (None, None) and got[9] == (None, None)
    assert {r.ex_i: (r.x_pm, r.z_pm) for r in units.examples.collect()} == {"a": (500000.0, None), "b": (1000000.0, None), "c": (None, None)}
    assert CommonUnits(obj.limit(0), ex.limit(0)).objects().count() == 0


def test_salted(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(50)}", rng.choice([None, math.nan, 1.0, 2.5, 4.0]), i) for i in range(3000)] + [(None, 1.0, 0)] * 20
    df = spark.createDataFrame(rows, "key string, v double, _mq int")
    measures = [Measure("n", "count", F.nanvl("v", F.lit(None).cast("double"))), Measure("total", "sum", F.col("v")), Measure("mean", "avg", F.col("v")), Measure("sd", "std", F.col("v")), Measure("low", "min", F.col("v"))]
    got = {r.key: r for r in salted_aggregate(df, "key", measures, salts=8, share=0.05).collect()}
    import statistics

    for key in {r[0] for r in rows if r[0]}:
        own = [r[1] for r in rows if r[0] == key]
        real = [v for v in own if v is not None and v == v]
        assert got[key].n_rows == len(own) and got[key].n == len(real) and got[key].low == min(real)
        assert got[key].total == pytest.approx(sum(real)) and got[key].sd == pytest.approx(statistics.stdev(real))
    assert None not in got and salted_aggregate(df.limit(0), "key", measures).count() == 0


def test_heavy_keys_get_many_salts_even_without_other_columns(spark):
    rows = [("hot",)] * 4000 + [("warm",)] * 900 + [(f"k{i}",) for i in range(900)]
    df = spark.createDataFrame(rows, "key string").repartition(3)
    parts = partials(df, "key", [], salts=16, share=0.05)
    salts = {r.key: r["n"] for r in parts.groupBy("key").agg(F.count_distinct("_mq_salt").alias("n")).collect()}
    assert salts["hot"] == salts["warm"] == 16 and salts["k5"] == 1
    assert max(r["_mq_rows"] for r in parts.collect()) < 1000
    assert {r.key: r.n_rows for r in merge(parts, ["key"], []).collect()} == {"hot": 4000, "warm": 900} | {f"k{i}": 1 for i in range(900)}


def forest(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([None, rng.randrange(n), rng.randrange(max(1, i)), 10_000]), f"n{i}") for i in range(n)]


@pytest.mark.parametrize("nodes", [50_000, 5])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy(spark, seed, nodes):
    rows = forest(seed, 120)
    parent = {i: p if p in range(120) else None for i, p, _ in rows}
    df = spark.createDataFrame(rows + rows[:10] + [(None, 3, "x")], "id long, up long, name string").withColumn("comp", F.lit(1))
    got = {r.id: r for r in hierarchy(df, "id", "up", "name", task_nodes=nodes).collect()}
    assert len(got) == 120
    below = dict.fromkeys(parent, 0)
    for i in parent:
        way, at = [i], parent[i]
        while at is not None and at not in way:
            way.append(at)
            at = parent[at]
        if at is None:
            for a in way[1:]:
                below[a] += 1
            assert (got[i].state, got[i].root_id, got[i].depth) == ("tree", way[-1], len(way))
            assert got[i].path == "/" + "/".join(map(str, way[::-1])) + "/" and got[i].names == "/" + "/".join(f"n{a}" for a in way[::-1]) + "/"
        else:
            loop = set(way[way.index(at) :])
            assert got[i].state == ("cycle" if i in loop else "below_cycle") and (got[i].root_id, got[i].depth, got[i].path, got[i].n_descendants) == (-1, -1, "", -1)
    assert all(got[i].n_descendants == below[i] for i in parent if got[i].state == "tree")
    assert closure(hierarchy(df, "id", "up")).count() == sum(r.depth for r in got.values() if r.state == "tree")


def test_hierarchy_ends(spark):
    df = spark.createDataFrame([(1, 1), (2**60, None), (2**60 + 1, 2**60)], "id long, up long")
    got = {r.id: (r.state, r.depth) for r in hierarchy(df, "id", "up").collect()}
    assert got == {1: ("cycle", -1), 2**60: ("tree", 1), 2**60 + 1: ("tree", 2)}
    assert hierarchy(df.limit(0), "id", "up").count() == 0
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(3000)], "id long, up long")
    assert hierarchy(chain, "id", "up").agg(F.max("depth")).first()[0] == 3000


def test_flatten(spark, tmp_path):
    disp = {"ex_i": "e1", "exmd": json.dumps({"data_metadata": {"channel_info": {"1": "B", "0": "A"}}, "COLOCALIZE_PARAMS": {"colocalizations": [[0, 1], None, [1, 0]]}}), "rois": {"name": "r", "polygons": [None, {"label": 7}, {}]}}
    bare = {"ex_i": "e2", "exmd": {"data_metadata": {"channel_info": ["X", None, "Y"]}}, "rois": []}
    lone = {"dispatcher_configs": {"ex_i": "e3", "exmd": None, "rois": {}}}
    listed = {"dispatcher_configs": {"ex_i": "e4", "exmd": {"data_metadata": {"channel_info": [{"index": 2, "name": "C"}]}}}}
    rows = [(1, json.dumps({"dispatcher_configs": {"4": disp, "2": bare}})), (1, json.dumps({"dispatcher_configs": {"4": disp, "2": bare}})), (2, json.dumps(lone)), (3, json.dumps(listed)), (4, "{broken"), (5, None), (6, "NaN"), (7, "[]"), (None, json.dumps(lone)), (8, ""), (9, json.dumps({"dispatcher_configs": json.dumps([None, bare])}))]
    out = tagged(spark.createDataFrame(rows, "rid long, j string"), "rid", "j", TREE)
    got = sorted((r.record, r.tag, r.pk, json.loads(r.payload)["name"]) for r in out.collect())
    assert (1, "channel", "1/dispatcher:4/channel:0", "A") in got and (1, "polygon", "1/dispatcher:4/roi:0/polygon:1", "7") in got
    assert [g for g in got if g[1] == "colocalization"] == [(1, "colocalization", "1/dispatcher:4/colocalization:0", "0+1"), (1, "colocalization", "1/dispatcher:4/colocalization:2", "1+0")]
    assert [g[2] for g in got if g[1] == "dispatcher"] == ["1/dispatcher:2", "1/dispatcher:4", "2/dispatcher:0", "3/dispatcher:0", "9/dispatcher:1"]
    assert (3, "channel", "3/dispatcher:0/channel:2", "C") in got and sum(g[1] == "roi" for g in got) == 1
    parents = {g[2] for g in got} | {str(r) for r in range(10)}
    assert all(r.parent in parents for r in out.collect())
    write_tables(out, str(tmp_path / "t"))
    assert apply_schema(spark.read.parquet(str(tmp_path / "t")), "polygon", "name string, area_px long").count() == 1
    assert tagged(spark.createDataFrame([], "rid long, j string"), "rid", "j", TREE).count() == 0
