"""Images painted from polygons: the same as set operations on their places, which are never moved."""

import random

import pytest
from pyspark.sql import functions as F
from test_pixels import BOX, SCHEMA

from morphoquarry.operators import geometry, morphology
from morphoquarry.plans import pixels
from morphoquarry.plans.aggregates import voxels

KEYS = (["ex_i"], ["y", "x"], "poly_id")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d, rows = random.Random(8), str(tmp_path_factory.mktemp("painted")), []
    for i in range(1, 41):
        x, y, w, h = rng.randrange(30), rng.randrange(30), rng.randrange(3, 22), rng.randrange(3, 22)
        ring = BOX(float(x), float(y), float(w), float(h)) if i % 3 else [(x + rng.random() * w, y + rng.random() * h) for _ in range(7)]
        rows.append((i, "abcd"[i % 4], rng.randrange(3), 0, 0, ring, [BOX(x + 1.0, y + 1.0, w / 2, h / 2), BOX(x + 2.5, y + 1.5, w / 2, h / 3)] if i % 2 else None))
    rows += [(50, "e", 1, 0, 0, [(1.0, 1.0), (2.0, 2.0)], None), (51, None, 1, 0, 0, BOX(0.0, 0.0, 6.0, 5.0), None), (52, None, 1, 0, 0, BOX(4.0, 0.0, 6.0, 5.0), None)]
    spark.createDataFrame(rows + rows[:3], SCHEMA).write.parquet(f"{d}/roi_polygons.parquet")
    return d


def places(spark, d):
    at = [F.col(c).cast("long").alias(c) for c in "yx"]
    return voxels(spark, d, pixels.PIXELS).groupBy("ex_i", *at).agg(F.min("poly_id").alias("poly_id"))


def flood(spark, d):
    p = places(spark, d)
    first = p.groupBy("ex_i", "poly_id").agg(F.min(F.struct("y", "x")).alias("s")).select("ex_i", "poly_id", "s.y", "s.x", F.col("poly_id").alias("seed"))
    return morphology.flood(p.join(first, ["ex_i", "poly_id", "y", "x"], "left").withColumn("v", F.pmod(F.col("y") * 7 + F.col("x") * 13, F.lit(32)).cast("double")), ["ex_i"], ["y", "x"], "v", "seed").where("ex_i IS NOT NULL")


def parts(spark, d):
    v = voxels(spark, d, pixels.PIXELS).where("ex_i IS NOT NULL").withColumns({c: F.col(c).cast("long") for c in "yx"})
    return morphology.part_labels(v, ["ex_i"], ["y", "x"], "label").groupBy("ex_i", "label", "part").agg(F.count(F.lit(1)).alias("area")).drop("part")


WANT = {
    "pixel_dilate_labels": lambda s, d: morphology.dilate(places(s, d), *KEYS),
    "pixel_flood_from_seeds": flood,
    "pixel_mask_outlines": lambda s, d: morphology.outline_places(places(s, d), *KEYS).drop("poly_id"),
    "pixel_erode_labels": lambda s, d: morphology.erode(places(s, d), *KEYS),
    "pixel_downsample_mean": lambda s, d: morphology.downsample(places(s, d), ["ex_i"], ["y", "x"], "poly_id", 4).withColumnRenamed("poly_id", "v").withColumn("v", F.round("v", 6)),
    "pixel_label_components": parts,
    "pixel_polygonise": lambda s, d: geometry.outlines(voxels(s, d, pixels.PIXELS).where("ex_i IS NOT NULL"), ["ex_i"], "poly_id"),
    "pixel_shrink_objects": lambda s, d: morphology.shrink(places(s, d), *KEYS, 3),
}


@pytest.mark.parametrize("name", WANT)
def test_same_as_set_operations(spark, folder, name):
    got, want = pixels.QUERIES[name](spark, folder), WANT[name](spark, folder)
    if name in ("pixel_label_components", "pixel_polygonise"):
        got = got.where("ex_i IS NOT NULL")
    assert sorted(got.columns) == sorted(want.columns) and want.count() > 0
    of = lambda df: sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert of(got) == of(want)


@pytest.mark.parametrize("name", [*WANT, "pixel_skeleton_lengths", "roi_mask_summary"])
def test_only_polygons_move(spark, folder, name):
    plan = pixels.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_thinning_and_ways():
    def peeled(places):
        ring, out = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)], set(places)
        while True:
            before = len(out)
            for side in (0, 1):
                gone = set()
                for y, x in out:
                    n = [(y + dy, x + dx) in out for dy, dx in ring]
                    up, right, down, left = n[::2]
                    shut = (up and right and down) or (right and down and left) if side == 0 else (up and right and left) or (up and down and left)
                    if 2 <= sum(n) <= 6 and sum(not n[i - 1] and n[i] for i in range(8)) == 1 and not shut:
                        gone.add((y, x))
                out -= gone
            if len(out) == before:
                return out

    rng = random.Random(3)
    for fill in (0.5, 0.8, 0.95):
        shape = {(y, x) for y in range(-4, 25) for x in range(3, 40) if rng.random() < fill}
        assert morphology.thinned(shape) == peeled(shape)
    assert morphology.thinned(set()) == set()
    # a frame has no end; its ways cut the corner that they pass
    frame = {(y, x) for y in range(501) for x in range(501) if y in (0, 500) or x in (0, 500)}
    assert morphology.longest_way(frame) == pytest.approx(998 + 2**0.5)
