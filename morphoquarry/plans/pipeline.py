"""Colocalisation, region assignment and the four stages of a run, over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import colocalize as c
from morphoquarry.operators import filters as f
from morphoquarry.operators.assign import Regions, assign_regions
from morphoquarry.operators.geometry import polygon_area
from morphoquarry.plans.aggregates import POLY_SQL, polygons
from morphoquarry.plans.pixels import _MET, _runs, _sql
from morphoquarry.plans.relational import IDS, PASS_SQL, THRESHOLDS
from morphoquarry.plans.spatial import INSIDE_SQL, POINTS_SQL, points
from morphoquarry.plans.spatial import SQL as SPATIAL_SQL
from morphoquarry.plans.pixels import SQL as PIXEL_SQL
from morphoquarry.plans.stages import Data, Stage, run
from morphoquarry.sources.tables import OBJECTS_SQL, objects, table

ON_CHANNELS = [c.Composite((1, 0), 3), c.Composite((2, 1, 0), 4)]
ON_IDS = [c.Composite((1, 2), 3), c.Composite((0, 1, 2), 4)]
REACH = 10.0


def overlap_colocalize(spark: SparkSession, d: str) -> DataFrame:
    got = c.overlap_colocalize(_runs(spark, d, ["ex", "id", "c"]), ON_CHANNELS)
    return got.select(F.col("ex").alias("ex_i"), "assign", "base", F.col("partners")[1].alias("ch1"), F.col("partners")[2].alias("ch2"), F.round("share", 9).alias("share"))


def overlap_colocalize_union(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs by another metric: what is shared over both objects together."""
    got = c.overlap_colocalize(_runs(spark, d, ["ex", "id", "c"]), ON_CHANNELS[:1], 0.05, c.share_of_union)
    return got.select(F.col("ex").alias("ex_i"), "base", F.col("partners")[1].alias("ch1"), F.round("share", 9).alias("iou"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    return c.distance_colocalize(points(spark, d).where("ex_i IS NOT NULL"), ON_IDS, "obj_id", "colocal_id", ["x", "y"], ["ex_i"], REACH)


def distance_colocalize(spark: SparkSession, d: str) -> DataFrame:
    got = _near(spark, d)
    return got.select("assign", "base", *[F.col("partners")[k].alias(f"ch{k}_label") for k in (0, 1)], *[F.round(F.col("distances")[k], 6).alias(f"ch{k}_distance") for k in (0, 1)], F.round("mean_distance", 6).alias("mean_distance"))


def roi_assignment(spark: SparkSession, d: str) -> DataFrame:
    t = Regions(points(spark, d).where("ex_i IS NOT NULL").select("obj_id", "ex_i", "x", "y"), polygons(spark, d), "obj_id", "ex_i")
    return assign_regions(t, ["Centroid", "Masking", "Distance"]).select("obj_id", "roi_i_byCentroid", "roi_polyi_byCentroid", "roi_i_byMasking", "roi_i_byDistance", "roi_polyi_byDistance", F.round("roi_distance", 6).alias("roi_distance"))


# stages


def _detect(t: Data) -> Data:
    """Objects within their id's thresholds, with the attributes of their example."""
    kept = f.thresholds_by_id(t["objects"], "colocal_id", f.spread_thresholds(THRESHOLDS, IDS))
    return {"objects": kept.join(t["examples"].select("ex_i", "animal_number", "treatment", "genotype"), "ex_i", "left")}


def _colocalize(t: Data) -> Data:
    """Composite objects appended to the objects."""
    placed = t["points"].join(t["objects"].select("obj_id"), "obj_id", "left_semi").where("ex_i IS NOT NULL")
    found = c.distance_colocalize(placed, ON_IDS, "obj_id", "colocal_id", ["x", "y"], ["ex_i"], REACH).select("base", "assign", F.col("mean_distance").alias("share"))
    return {"objects": c.with_composites(t["objects"], found, "obj_id", "colocal_id")}


def _regions(t: Data) -> Data:
    """The region of each object by its centroid; 0 for none or no place in pixels."""
    at = assign_regions(Regions(t["points"].where("ex_i IS NOT NULL").select("obj_id", "ex_i", "x", "y"), t["polygons"], "obj_id", "ex_i"), ["Centroid"])
    return {"objects": t["objects"].join(at.select("obj_id", F.col("roi_i_byCentroid").alias("region")), "obj_id", "left").withColumn("region", F.coalesce("region", F.lit(0)))}


def _quantify(t: Data) -> Data:
    """Objects, their mean intensity and their density per example, region and id."""
    counts = t["objects"].where("region > 0").groupBy("ex_i", "region", "colocal_id").agg(F.count(F.lit(1)).alias("n"), F.avg("intensity_mean").alias("intensity_mean"))
    area = t["polygons"].groupBy("ex_i", F.col("label").alias("region")).agg(F.sum(polygon_area(F.col("ring"), F.col("holes"))).alias("area"))
    return {"counts": counts.join(area, ["ex_i", "region"], "left").withColumn("density", F.try_divide("n", "area"))}


DETECTION = Stage("detection", _detect, lambda t: {"detected": t["objects"]}, needs=("objects", "examples"))
COLOCALIZATION = Stage("colocalization", _colocalize, lambda t: {"colocalized": t["objects"]}, needs=("objects", "points"), after=("detection",))
REGIONS = Stage("regions", _regions, lambda t: {"placed": t["objects"]}, needs=("objects", "points", "polygons"), after=("colocalization",))
QUANTIFICATION = Stage("quantification", _quantify, lambda t: {"counts": t["counts"]}, needs=("objects", "polygons"), after=("regions",))
LINE = [QUANTIFICATION, REGIONS, DETECTION, COLOCALIZATION]


def _line(spark: SparkSession, d: str, stages: list[Stage]) -> Data:
    return run(stages, {"objects": objects(spark, d), "examples": table(spark, d, "exmd"), "points": points(spark, d), "polygons": polygons(spark, d)})[1]


def stage_detection(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, [DETECTION])["detected"].select("obj_id", "ex_i", "colocal_id", "animal_number", "treatment", "genotype")


def stage_colocalization(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, [COLOCALIZATION, DETECTION])["colocalized"].select("obj_id", "ex_i", "colocal_id", F.round("share", 6).alias("share"))


def stage_regions(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, LINE[1:])["placed"].select("obj_id", "colocal_id", "region")


def stage_quantification(spark: SparkSession, d: str) -> DataFrame:
    out = _line(spark, d, LINE)["counts"]
    return out.select("ex_i", "region", "colocal_id", "n", F.round("intensity_mean", 6).alias("intensity_mean"), F.round("area", 4).alias("area"), F.round("density", 9).alias("density"))


_BEST = f"{_MET}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ex_i, id, oc ORDER BY shared DESC, other) AS k FROM s WHERE c = 0 AND oc IN (1, 2)) WHERE k = 1)"
_PAIR = """WITH {W}p AS (SELECT * FROM {PTS} WHERE ex_i IS NOT NULL{AND}), j AS (SELECT a.obj_id AS base, b.colocal_id AS ch, b.obj_id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.ex_i = b.ex_i AND a.colocal_id = 2 AND b.colocal_id IN (0, 1)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base, ch ORDER BY d, other) AS k FROM j WHERE d < 10) WHERE k = 1),
z AS (SELECT CAST(3 AS BIGINT) AS assign, base, CAST(NULL AS BIGINT) AS ch0_label, other AS ch1_label, CAST(NULL AS DOUBLE) AS ch0_distance, d AS ch1_distance, d AS mean_distance FROM m WHERE ch = 1
UNION ALL SELECT 4, a.base, a.other, b.other, a.d, b.d, (a.d + b.d) / 2 FROM m a JOIN m b ON a.base = b.base AND a.ch = 0 AND b.ch = 1)"""
_Z = _PAIR.replace("{W}", "").replace("{AND}", "").replace("{PTS}", POINTS_SQL)
_KEPT = f"k AS (SELECT o.*, e.animal_number, e.treatment, e.genotype FROM {OBJECTS_SQL} o LEFT JOIN exmd e USING (ex_i) WHERE {PASS_SQL})"
_COLOCALIZED = _PAIR.replace("{W}", _KEPT + ", ").replace("{AND}", " AND obj_id IN (SELECT obj_id FROM k)").replace("{PTS}", POINTS_SQL) + """,
y AS (SELECT k.*, CAST(NULL AS DOUBLE) AS share FROM k UNION ALL SELECT k.* REPLACE (z.assign AS colocal_id), z.mean_distance FROM k JOIN z ON z.base = k.obj_id)"""
_PLACED = f"""{_COLOCALIZED}, i AS (SELECT obj_id, label FROM (SELECT obj_id, label, row_number() OVER (PARTITION BY obj_id ORDER BY label, sub_idx, poly_id) AS k FROM {INSIDE_SQL} JOIN {POLY_SQL} USING (poly_id)) WHERE k = 1),
x AS (SELECT y.*, coalesce(i.label, 0) AS region FROM y LEFT JOIN i USING (obj_id))"""
_RING = "abs(list_sum(list_transform(range(1, len({r}) + 1), lambda i: {r}[i].x * {r}[i % len({r}) + 1].y - {r}[i % len({r}) + 1].x * {r}[i].y))) / 2"
_AREA = f"""(SELECT ex_i, label AS region, sum(CASE WHEN len(ring) > 2 THEN {_RING.format(r="ring")} ELSE 0 END - coalesce(list_sum(list_transform(holes, lambda h: CASE WHEN len(h) > 2 THEN {_RING.replace("lambda i", "lambda q").replace("[i", "[q").format(r="h")} ELSE 0 END)), 0)) AS area FROM {POLY_SQL} GROUP BY ALL)"""
QUERIES = {fn.__name__: fn for fn in (overlap_colocalize, overlap_colocalize_union, distance_colocalize, roi_assignment, stage_detection, stage_colocalization, stage_regions, stage_quantification)}
SQL = {
    "overlap_colocalize": _sql(f"""{_BEST}, px AS (SELECT ex_i, poly_id, y, x FROM {{PIX}}), t AS (SELECT x.ex_i, x.id, x.other AS ch1, y.other AS ch2 FROM b x JOIN b y ON x.id = y.id AND x.oc = 1 AND y.oc = 2)
SELECT b.ex_i, CAST(3 AS BIGINT) AS assign, id AS base, other AS ch1, CAST(NULL AS BIGINT) AS ch2, round(shared / n.n, 9) AS share FROM b JOIN n ON n.poly_id = id WHERE oc = 1 AND shared / n.n > 0.001
UNION ALL SELECT t.ex_i, 4, id, ch1, ch2, round(count(*) / any_value(n.n), 9) FROM t JOIN n ON n.poly_id = id JOIN px a ON a.poly_id = id JOIN px o ON o.poly_id = ch1 AND o.y = a.y AND o.x = a.x JOIN px u ON u.poly_id = ch2 AND u.y = a.y AND u.x = a.x GROUP BY t.ex_i, id, ch1, ch2 HAVING count(*) / any_value(n.n) > 0.001"""),
    "overlap_colocalize_union": _sql(f"{_BEST} SELECT ex_i, id AS base, other AS ch1, round(shared / (p.n + q.n - shared), 9) AS iou FROM b JOIN n p ON p.poly_id = id JOIN n q ON q.poly_id = other WHERE oc = 1 AND shared / (p.n + q.n - shared) > 0.05"),
    "distance_colocalize": f"{_Z} SELECT assign, base, ch0_label, ch1_label, round(ch0_distance, 6) AS ch0_distance, round(ch1_distance, 6) AS ch1_distance, round(mean_distance, 6) AS mean_distance FROM z",
    "roi_assignment": f"""SELECT c.obj_id, c.roi AS "roi_i_byCentroid", c.poly_id AS "roi_polyi_byCentroid", m.roi AS "roi_i_byMasking", coalesce(p.label, 0) AS "roi_i_byDistance", coalesce(n.poly_id, -1) AS "roi_polyi_byDistance", n.distance AS roi_distance
FROM ({SPATIAL_SQL["point_in_polygon"]}) c JOIN ({PIXEL_SQL["pixel_raster_lookup"]}) m USING (obj_id) LEFT JOIN ({SPATIAL_SQL["nearest_polygon"]}) n USING (obj_id) LEFT JOIN {POLY_SQL} p ON p.poly_id = n.poly_id WHERE c.obj_id IN (SELECT obj_id FROM {OBJECTS_SQL} WHERE ex_i IS NOT NULL)""",
    "stage_detection": f"WITH {_KEPT} SELECT obj_id, ex_i, colocal_id, animal_number, treatment, genotype FROM k",
    "stage_colocalization": f"{_COLOCALIZED} SELECT obj_id, ex_i, colocal_id, round(share, 6) AS share FROM y",
    "stage_regions": f"{_PLACED} SELECT obj_id, colocal_id, region FROM x",
    "stage_quantification": f"{_PLACED} SELECT ex_i, region, colocal_id, n, round(intensity_mean, 6) AS intensity_mean, round(area, 4) AS area, round(n / nullif(area, 0), 9) AS density FROM (SELECT ex_i, region, colocal_id, count(*) AS n, avg(intensity_mean) AS intensity_mean FROM x WHERE region > 0 GROUP BY ALL) LEFT JOIN {_AREA} USING (ex_i, region)",
}
