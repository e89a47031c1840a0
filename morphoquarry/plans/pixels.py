"""Raster queries over every pixel, holes left out, held against SQL that makes every pixel too.

Every object is compared with all others of its example; where populations matter they are the channels, NULL being one
of them. Objects are held as runs of pixels along lines; only queries named ``pixel_`` that return or traverse single
pixels make them, and those without SQL are held against brute force in the tests.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import geometry as g
from morphoquarry.operators import painted
from morphoquarry.operators import runs as r
from morphoquarry.operators.twostage import stable
from morphoquarry.plans import aggregates, graphs, rasters, spatial
from morphoquarry.plans.aggregates import PIXELS, POLY_SQL, polygons
from morphoquarry.plans.spatial import POINTS_SQL
from morphoquarry.session import Cut

_SAME = [
    aggregates.rasterise, aggregates.axis_max_projection, aggregates.label_extent, aggregates.densest_tile,
    spatial.raster_lookup, spatial.polygonise, graphs.label_components,
    rasters.dilate_labels, rasters.erode_labels, rasters.mask_outlines, rasters.shrink_objects, rasters.downsample_mean, rasters.flood_from_seeds, rasters.skeleton_lengths,
]


def _runs(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    polys = polygons(spark, d).where("ex_i IS NOT NULL AND poly_id IS NOT NULL").select(F.col("ex_i").alias("ex"), F.col("poly_id").alias("id"), F.coalesce("channel", F.lit(-1)).alias("c"), "ring", "holes")
    return stable(r.solid(g.spans(polys, keys, "ring", PIXELS.pitch, "holes"), keys))


def max_overlap_assign(spark: SparkSession, d: str) -> DataFrame:
    """The other object that shares most pixels with each; ties go to the smaller id."""
    runs = _runs(spark, d, ["ex", "id"])
    n = r.sizes(runs)
    best = r.shared(runs).groupBy("ex", "id").agg(F.min_by(F.struct("other", "shared"), F.struct(-F.col("shared"), F.col("other"))).alias("s")).select("ex", "id", "s.*")
    full = best.join(n.select("ex", "id", "n"), ["ex", "id"]).join(n.select("ex", F.col("id").alias("other"), F.col("n").alias("m")), ["ex", "other"])
    return full.select(F.col("ex").alias("ex_i"), F.col("id").alias("left_id"), F.col("other").alias("right_id"), "shared", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 9).alias("iou"))


def coords_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return r.first_hits(_runs(spark, d, ["ex", "id"])).select(F.col("ex").alias("ex_i"), F.col("id").alias("poly_id"), F.col("other").alias("region"))


def overlap_coloc_iou(spark: SparkSession, d: str) -> DataFrame:
    out = r.triple_shares(_runs(spark, d, ["ex", "id", "c"]))
    return out.select(F.col("ex").alias("ex_i"), F.col("id").alias("base"), F.col("first").alias("ch1"), F.col("second").alias("ch2"), F.round("share", 9).alias("iou"))


def min_distance_assign(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other object of the example by the least distance between pixels, however far away."""
    out = r.nearest(_runs(spark, d, ["ex", "id"]), Cut(spark))
    return out.select(F.col("ex").alias("ex_i"), F.col("id").alias("poly_id"), F.col("other").alias("target"), F.round("d", 6).alias("distance"))


def pixel_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel of every object, as runs along lines."""
    return _runs(spark, d, ["ex", "id"]).select(F.col("ex").alias("ex_i"), F.col("id").alias("poly_id"), "row", "lo", "hi")


def region_properties(spark: SparkSession, d: str) -> DataFrame:
    """Shape of each object, with its perimeter along pixel edges and its circularity 4π·area / perimeter²."""
    runs = _runs(spark, d, ["ex", "id"])
    out = r.properties(runs).join(r.perimeters(runs), ["ex", "id"])
    rounded = [F.round(c, 5).alias(c) for c in ("cy", "cx", "axis_major_length", "axis_minor_length", "extent", "equivalent_diameter", "perimeter")]
    return out.select(F.col("ex").alias("ex_i"), F.col("id").alias("poly_id"), "area", "y0", "x0", "y1", "x1", *rounded, F.round(4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter")), 6).alias("circularity"))


def average_iou(spark: SparkSession, d: str) -> DataFrame:
    """Per example: the mean, over objects of channel 0, of the IoU with the object of channel 1 that overlaps most; 0 without one."""
    runs = _runs(spark, d, ["ex", "id", "c"])
    truth, found = runs.where("c = 0").drop("c"), runs.where("c = 1").drop("c")
    pairs = r.met(truth, found).groupBy("ex", "id", "other").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("shared"))
    sizes = r.sizes(runs.drop("c")).select("ex", "id", "n")
    iou = pairs.join(sizes, ["ex", "id"]).join(sizes.select("ex", F.col("id").alias("other"), F.col("n").alias("m")), ["ex", "other"]).select("ex", "id", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("iou"))
    best = iou.groupBy("ex", "id").agg(F.max("iou").alias("iou"))
    every = truth.select("ex", "id").distinct().join(best, ["ex", "id"], "left")
    return every.groupBy(F.col("ex").alias("ex_i")).agg(F.round(F.avg(F.coalesce("iou", F.lit(0.0))), 9).alias("mean_iou"), F.count(F.lit(1)).alias("n"))


def roi_mask_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per example and region label of the mask: pixels; label 0 is the background within the box of all regions. Of overlapping regions the smallest label holds the pixel."""
    polys = polygons(spark, d).where("ex_i IS NOT NULL AND poly_id IS NOT NULL AND label IS NOT NULL")

    def areas(s: painted.Shapes) -> dict:
        image = s.painted()
        plane, row, lo, hi = image.places()
        of, which = np.unique(np.stack([plane, image.id], 1), axis=0, return_inverse=True)
        label = np.bincount(which.ravel(), hi - lo + 1, len(of)).astype(np.int64)
        new = np.flatnonzero(np.append(True, plane[1:] != plane[:-1])[: len(plane)])
        height, width = (np.maximum.reduceat(b, new) - np.minimum.reduceat(a, new) + 1 if len(new) else new for a, b in ((row, row), (lo, hi)))
        ground = height * width - np.add.reduceat(hi - lo + 1, new) if len(new) else new
        return {"ex_i": s.names.take(np.append(of[:, 0], plane[new])), "label": np.append(of[:, 1], 0 * new), "area": np.append(label, ground)}

    return painted.by_image(polys, "ex_i", "label", "ring", "holes", PIXELS.pitch, areas, "ex_i string, label long, area long")


def _sql(text: str) -> str:
    return text.replace("{PIX}", _PIXELS_SQL).replace("{RUN}", _RUNS_SQL).replace("{PTS}", POINTS_SQL)


_RUNS_SQL = """(WITH parts AS (SELECT poly_id, ex_i, label, channel, 0 AS part, ring AS pts FROM {POLY} WHERE len(ring) > 2 UNION ALL SELECT poly_id, ex_i, label, channel, unnest(range(1, len(holes) + 1)), unnest(holes) FROM {POLY} WHERE len(ring) > 2 AND holes IS NOT NULL),
e AS (SELECT * EXCLUDE pts, unnest(pts) AS a, unnest(list_append(pts[2:], pts[1])) AS b FROM parts WHERE len(pts) > 2),
v AS (SELECT poly_id, ex_i, label, channel, part, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM e WHERE a.y <> b.y),
l AS (SELECT *, unnest(range(CAST(ceil(least(y1, y2)) AS BIGINT), CAST(ceil(greatest(y1, y2)) AS BIGINT))) AS r FROM v),
k AS (SELECT poly_id, ex_i, label, channel, part, r, x1 + (r - y1) * (x2 - x1) / (y2 - y1) AS cx FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY poly_id, part, r ORDER BY cx) AS i, lead(cx) OVER (PARTITION BY poly_id, part, r ORDER BY cx) AS nx FROM k),
s AS (SELECT poly_id, ex_i, label, channel, part, r, CAST(ceil(cx) AS BIGINT) AS lo, CAST(ceil(nx) - 1 AS BIGINT) AS hi FROM n WHERE i % 2 = 1 AND ceil(cx) <= ceil(nx) - 1),
h AS (SELECT poly_id, r, list(struct_pack(lo := lo, hi := hi)) AS hs FROM s WHERE part > 0 GROUP BY ALL),
c AS (SELECT s.*, list_distinct(list_filter(list_prepend(s.lo, list_transform(coalesce(hs, []), lambda q: q.hi + 1)), lambda p: p BETWEEN s.lo AND s.hi AND len(list_filter(coalesce(hs, []), lambda q: p BETWEEN q.lo AND q.hi)) = 0)) AS starts, coalesce(hs, []) AS hs FROM s LEFT JOIN h USING (poly_id, r) WHERE part = 0),
u AS (SELECT * EXCLUDE starts, unnest(starts) AS a FROM c)
SELECT ex_i, poly_id, label, channel, r, a AS lo, least(hi, coalesce(list_min(list_transform(list_filter(hs, lambda q: q.lo > a), lambda q: q.lo - 1)), hi)) AS hi FROM u)""".replace("{POLY}", POLY_SQL)
_PIXELS_SQL = f"(SELECT ex_i, poly_id, label, coalesce(channel, -1) AS c, r AS y, unnest(range(lo, hi + 1)) AS x FROM {_RUNS_SQL})"
QUERIES = {f"pixel_{fn.__name__}": partial(fn, grid=PIXELS) for fn in _SAME}
QUERIES |= {fn.__name__: fn for fn in (max_overlap_assign, coords_first_hit, overlap_coloc_iou, min_distance_assign, pixel_runs, region_properties, average_iou, roi_mask_summary)}
_SHARED = "w AS (SELECT ex_i, poly_id, coalesce(channel, -1) AS c, r, lo, hi FROM {RUN}), n AS (SELECT poly_id, sum(hi - lo + 1) AS n FROM w GROUP BY ALL)"
_MET = f"WITH {_SHARED}, s AS (SELECT a.ex_i, a.poly_id AS id, b.poly_id AS other, a.c, b.c AS oc, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) AS BIGINT) AS shared FROM w a JOIN w b ON a.ex_i = b.ex_i AND a.r = b.r AND a.poly_id <> b.poly_id AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL)"
SQL = {
    name: _sql(text)
    for name, text in {
        "pixel_runs": "SELECT ex_i, poly_id, r AS row, lo, hi FROM {RUN}",
        "pixel_axis_max_projection": "SELECT ex_i, CAST(x AS DOUBLE) AS x, max(label) AS v FROM {PIX} GROUP BY ex_i, x",
        "pixel_label_extent": "SELECT ex_i, label, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM {PIX} GROUP BY ALL",
        "pixel_densest_tile": "SELECT ex_i, ty, tx, n FROM (SELECT *, row_number() OVER (PARTITION BY ex_i ORDER BY n DESC, ty, tx) AS k FROM (SELECT ex_i, CAST(floor(y / 64) AS BIGINT) AS ty, CAST(floor(x / 64) AS BIGINT) AS tx, count(*) AS n FROM {PIX} GROUP BY ALL)) WHERE k = 1",
        "pixel_raster_lookup": "SELECT p.obj_id, coalesce(min(w.label), 0) AS roi FROM {PTS} p LEFT JOIN {RUN} w ON w.ex_i = p.ex_i AND w.r = CAST(round_even(p.y, 0) AS BIGINT) AND round_even(p.x, 0) BETWEEN w.lo AND w.hi GROUP BY p.obj_id",
        "region_properties": """WITH p AS (SELECT ex_i, poly_id, y, x FROM {PIX}), e AS (SELECT poly_id, count(*) AS k FROM (SELECT p.poly_id FROM p JOIN p q ON q.poly_id = p.poly_id AND q.y = p.y AND q.x = p.x + 1 UNION ALL SELECT p.poly_id FROM p JOIN p q ON q.poly_id = p.poly_id AND q.x = p.x AND q.y = p.y + 1) GROUP BY ALL),
m AS (SELECT ex_i, poly_id, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, avg(y) AS cy, avg(x) AS cx, (var_pop(y) + var_pop(x)) / 2 + 1.0 / 12 AS h, sqrt(pow(var_pop(y) - var_pop(x), 2) / 4 + pow(covar_pop(y, x), 2)) AS root FROM p GROUP BY ALL)
SELECT ex_i, m.poly_id, area, y0, x0, y1, x1, round(cy, 5) AS cy, round(cx, 5) AS cx, round(4 * sqrt(h + root), 5) AS axis_major_length, round(4 * sqrt(greatest(h - root, 0)), 5) AS axis_minor_length, round(area / ((y1 - y0) * (x1 - x0)), 5) AS extent,
round(sqrt(4 * area / pi()), 5) AS equivalent_diameter, CAST(4 * area - 2 * coalesce(k, 0) AS DOUBLE) AS perimeter, round(4 * pi() * area / pow(4 * area - 2 * coalesce(k, 0), 2), 6) AS circularity FROM m LEFT JOIN e USING (poly_id)""",
        "max_overlap_assign": f"{_MET} SELECT ex_i, id AS left_id, other AS right_id, shared, round(shared / (p.n + q.n - shared), 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY ex_i, id ORDER BY shared DESC, other) AS k FROM s) JOIN n p ON p.poly_id = id JOIN n q ON q.poly_id = other WHERE k = 1",
        "coords_first_hit": """WITH p AS (SELECT ex_i, poly_id, y, x FROM {PIX}), m AS (SELECT poly_id, avg(y) AS cy, avg(x) AS cx FROM p GROUP BY ALL)
SELECT ex_i, poly_id, other AS region FROM (SELECT a.ex_i, a.poly_id, b.poly_id AS other, row_number() OVER (PARTITION BY a.ex_i, a.poly_id ORDER BY min(round(pow(a.y - cy, 2) + pow(a.x - cx, 2), 6)), b.poly_id) AS k FROM p a JOIN p b ON a.ex_i = b.ex_i AND a.y = b.y AND a.x = b.x AND a.poly_id <> b.poly_id JOIN m ON m.poly_id = a.poly_id GROUP BY a.ex_i, a.poly_id, b.poly_id) WHERE k = 1""",
        "overlap_coloc_iou": f"""{_MET}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ex_i, id, oc ORDER BY shared DESC, other) AS k FROM s WHERE c <> oc) WHERE k = 1),
t AS (SELECT x.ex_i, x.id, x.other AS ch1, y.other AS ch2 FROM b x JOIN b y ON x.ex_i = y.ex_i AND x.id = y.id AND x.oc < y.oc), px AS (SELECT ex_i, poly_id, y, x FROM {{PIX}})
SELECT t.ex_i, id AS base, ch1, ch2, round(count(*) / any_value(n.n), 9) AS iou FROM t JOIN n ON n.poly_id = id JOIN px a ON a.ex_i = t.ex_i AND a.poly_id = id JOIN px o ON o.ex_i = t.ex_i AND o.poly_id = ch1 AND o.y = a.y AND o.x = a.x JOIN px u ON u.ex_i = t.ex_i AND u.poly_id = ch2 AND u.y = a.y AND u.x = a.x GROUP BY t.ex_i, id, ch1, ch2""",
        "min_distance_assign": """WITH w AS (SELECT ex_i, poly_id, r, lo, hi FROM {RUN}) SELECT ex_i, id AS poly_id, other AS target, round(sqrt(d2), 6) AS distance FROM (SELECT ex_i, id, other, d2, row_number() OVER (PARTITION BY ex_i, id ORDER BY d2, other) AS k
FROM (SELECT a.ex_i, a.poly_id AS id, b.poly_id AS other, min(pow(a.r - b.r, 2) + pow(greatest(0, a.lo - b.hi, b.lo - a.hi), 2)) AS d2 FROM w a JOIN w b ON a.ex_i = b.ex_i AND a.poly_id <> b.poly_id GROUP BY ALL)) WHERE k = 1""",
        "average_iou": f"""{_MET} SELECT ex_i, round(avg(coalesce(iou, 0)), 9) AS mean_iou, count(*) AS n FROM (SELECT DISTINCT ex_i, poly_id FROM w WHERE c = 0) LEFT JOIN
(SELECT id AS poly_id, max(shared / (p.n + q.n - shared)) AS iou FROM s JOIN n p ON p.poly_id = id JOIN n q ON q.poly_id = other WHERE c = 0 AND oc = 1 GROUP BY ALL) USING (poly_id) GROUP BY ex_i""",
        "roi_mask_summary": """WITH m AS (SELECT ex_i, y, x, min(label) AS label FROM {PIX} WHERE label IS NOT NULL GROUP BY ALL)
SELECT ex_i, label, count(*) AS area FROM m GROUP BY ALL UNION ALL SELECT ex_i, 0, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) - count(*) FROM m GROUP BY ex_i""",
    }.items()
}
