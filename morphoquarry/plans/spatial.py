"""Neighbourhoods, colocalisation and region joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphoquarry.operators import geometry as g
from morphoquarry.operators import neighbours as n
from morphoquarry.operators import painted
from morphoquarry.operators.proximity import containing_polygons, near_pairs
from morphoquarry.operators.twostage import percentiles
from morphoquarry.plans.aggregates import COARSE, PITCH, PIXELS, POLY_SQL, VOXELS_SQL, Grid, polygons
from morphoquarry.session import Cut
from morphoquarry.sources.tables import OBJECTS_SQL, objects, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.replace("{OBJ}", OBJECTS_SQL).replace("{POLY}", POLY_SQL).replace("{VOX}", VOXELS_SQL).replace("{NBR}", NEIGHBOUR_SQL).replace("{PTS}", POINTS_SQL).replace("{INSIDE}", INSIDE_SQL)
        return fn

    return add


POINTS_SQL = """(SELECT obj_id, ex_i, colocal_id, dend_id, intensity_mean, centroid[len(centroid)] AS x, centroid[len(centroid) - 1] AS y FROM {OBJ} WHERE centroid_unit = 'px' AND centroid IS NOT NULL AND len(list_filter(centroid, lambda v: v IS NULL OR isnan(v))) = 0)""".replace("{OBJ}", OBJECTS_SQL)
#: Objects in pixels with the key of their neighbourhood: example, channel and dendrite.
NEIGHBOUR_SQL = """(SELECT obj_id, ex_i || '/' || colocal_id || '/' || dend_id AS key, centroid[len(centroid)] AS a, centroid[len(centroid) - 1] AS b, CASE WHEN len(centroid) > 2 THEN centroid[1] ELSE 0 END AS c, CASE WHEN NOT isnan(intensity_mean) THEN intensity_mean END AS f
FROM {OBJ} WHERE centroid_unit = 'px' AND dend_id IS NOT NULL AND centroid IS NOT NULL AND len(list_filter(centroid, lambda v: v IS NULL OR isnan(v))) = 0)""".replace("{OBJ}", OBJECTS_SQL)
#: Pixels within which objects of a dendrite are neighbours.
REACH = 6.0
INSIDE_SQL = """(SELECT obj_id, poly_id FROM (SELECT obj_id, poly_id, r FROM (SELECT poly_id, ex_i, r, unnest(pts) AS a, unnest(list_append(pts[2:], pts[1])) AS b FROM
(SELECT poly_id, ex_i, 0 AS r, ring AS pts FROM {POLY} UNION ALL SELECT poly_id, ex_i, unnest(range(1, len(coalesce(holes, [])) + 1)), unnest(coalesce(holes, [])) FROM {POLY}) WHERE len(pts) > 2) e JOIN {PTS} p USING (ex_i)
WHERE (e.a.y <= p.y) <> (e.b.y <= p.y) AND p.x < e.a.x + (p.y - e.a.y) * (e.b.x - e.a.x) / (e.b.y - e.a.y) GROUP BY obj_id, poly_id, r HAVING count(*) % 2 = 1) GROUP BY obj_id, poly_id HAVING max(r) = 0)""".replace("{POLY}", POLY_SQL).replace("{PTS}", POINTS_SQL)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("centroid")
    whole = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("dend_id").isNotNull()
    z = F.when(F.size(c) > 2, c[0]).otherwise(0.0)
    return objects(spark, d, (F.col("centroid_unit") == "px") & whole).select("obj_id", F.concat_ws("/", "ex_i", "colocal_id", "dend_id").alias("key"), F.element_at(c, -1).alias("a"), F.element_at(c, -2).alias("b"), z.alias("c"), F.when(~F.isnan("intensity_mean"), F.col("intensity_mean")).alias("f"))


def points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("centroid")
    whole = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    return objects(spark, d, (F.col("centroid_unit") == "px") & whole).select("obj_id", "ex_i", "colocal_id", "dend_id", "intensity_mean", F.element_at(c, -1).alias("x"), F.element_at(c, -2).alias("y"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return n.both_ways(near_pairs(_placed(spark, d), "obj_id", [F.col(c) for c in "abc"], [F.col("key")], REACH))


_NEAR = f"FROM {{NBR}} p JOIN {{NBR}} q ON p.key = q.key AND p.obj_id <> q.obj_id AND pow(p.a - q.a, 2) + pow(p.b - q.b, 2) + pow(p.c - q.c, 2) <= {REACH} * {REACH}"


@query(f"SELECT p.obj_id AS id, q.obj_id AS neighbour {_NEAR}")
def radius_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


@query("""SELECT id, neighbour, k AS "rank" FROM (SELECT p.obj_id AS id, q.obj_id AS neighbour, row_number() OVER (PARTITION BY p.obj_id ORDER BY pow(p.a - q.a, 2) + pow(p.b - q.b, 2) + pow(p.c - q.c, 2), q.obj_id) AS k
FROM {NBR} p JOIN {NBR} q ON p.key = q.key AND p.obj_id <> q.obj_id) WHERE k <= 5""")
def knn_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return n.nearest_neighbours(_placed(spark, d), "obj_id", [F.col(c) for c in "abc"], [F.col("key")], 5).select("id", "neighbour", "rank")


@query(f"SELECT p.obj_id AS id, count(q.f) AS n, round(avg(q.f), 6) AS mean, round(CASE WHEN count(q.f) > 0 THEN coalesce(stddev_samp(q.f), 0) END, 5) AS sd, round(avg(q.f) - any_value(p.f), 6) AS delta {_NEAR} GROUP BY p.obj_id HAVING count(q.f) > 0")
def neighbor_feature_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = n.neighbour_statistics(_links(spark, d), _placed(spark, d), "obj_id", "f")
    return stats.select("id", "n", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"), F.round("delta", 6).alias("delta"))


@query(f"SELECT quantile_cont(n, 0.05) AS q05, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.95) AS q95 FROM (SELECT count(*) AS n {_NEAR} GROUP BY p.obj_id)")
def neighbor_count_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = percentiles(_links(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n")), [], "n", [0.05, 0.5, 0.95], "q")
    return q.select(*[F.col("q")[i].alias(c) for i, c in enumerate(("q05", "q50", "q95"))])


@query(f"""WITH s AS (SELECT p.obj_id AS id, any_value(p.key) AS key, count(q.f) AS n, avg(q.f) AS mean {_NEAR} GROUP BY p.obj_id HAVING count(q.f) > 0), l AS (SELECT key, count(f) AS c, avg(f) AS m, stddev_pop(f) AS d FROM {{NBR}} GROUP BY key),
t AS (SELECT id, m, c, n, mean, CASE WHEN c > 1 THEN d / sqrt(n) * sqrt((c - n) / (c - 1.0)) END AS sd FROM s JOIN l USING (key) WHERE c > n)
SELECT id, round(m, 6) AS null_mean, round(sd, 5) AS null_sd, round(coalesce((mean - m) / nullif(sd, 0), 0), 4) AS z FROM t""")
def permutation_moments(spark: SparkSession, d: str) -> DataFrame:
    rows = _placed(spark, d)
    stats = n.neighbour_statistics(_links(spark, d), rows, "obj_id", "f").where("n > 0").join(rows.select(F.col("obj_id").alias("id"), "key"), "id")
    pools = rows.groupBy("key").agg(F.count("f").alias("pool_n"), F.avg("f").alias("pool_mean"), F.stddev_pop("f").alias("pool_sd"))
    return n.sampling_moments(stats, pools, ["key"]).where("pool_n > n").select("id", F.round("null_mean", 6).alias("null_mean"), F.round("null_sd", 5).alias("null_sd"), F.round("z", 4).alias("z"))


@query("""WITH p AS (SELECT * FROM {PTS}), j AS (SELECT a.obj_id AS id, b.obj_id AS match, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.ex_i = b.ex_i AND a.colocal_id = 2 AND b.colocal_id = 1)
SELECT id, match, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, match) AS k FROM j WHERE d < 10) WHERE k = 1""")
def centroid_nn_coloc(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return n.nearest_within(p.where("colocal_id = 2"), p.where("colocal_id = 1"), "obj_id", ["x", "y"], ["ex_i"], 10.0).withColumn("distance", F.round("distance", 6))


def _inside(spark: SparkSession, d: str) -> DataFrame:
    return containing_polygons(points(spark, d), "obj_id", F.col("x"), F.col("y"), [F.col("ex_i")], table(spark, d, "roi_polygons"), "poly_id", "ring", "holes", [F.col("ex_i")])


@query("""SELECT p.obj_id, coalesce(i.label, 0) AS roi, coalesce(i.poly_id, -1) AS poly_id FROM {PTS} p LEFT JOIN (SELECT obj_id, label, poly_id, row_number() OVER (PARTITION BY obj_id ORDER BY label, sub_idx, poly_id) AS k FROM {INSIDE} JOIN {POLY} USING (poly_id)) i ON i.obj_id = p.obj_id AND k = 1""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    poly = polygons(spark, d).select(F.col("poly_id").alias("poly"), "label", "sub_idx")
    first = _inside(spark, d).join(poly, "poly").groupBy(F.col("id").alias("obj_id")).agg(F.min(F.struct("label", "sub_idx", "poly")).alias("s"))
    return points(spark, d).select("obj_id").join(first, "obj_id", "left").select("obj_id", F.coalesce("s.label", F.lit(0)).alias("roi"), F.coalesce("s.poly", F.lit(-1)).alias("poly_id"))


@query("""SELECT obj_id, label, poly_id FROM (SELECT obj_id, label, poly_id, row_number() OVER (PARTITION BY obj_id ORDER BY label DESC, poly_id) AS k FROM {INSIDE} JOIN {POLY} USING (poly_id)) WHERE k = 1""")
def deepest_region_pip(spark: SparkSession, d: str) -> DataFrame:
    poly = polygons(spark, d).select(F.col("poly_id").alias("poly"), "label")
    best = _inside(spark, d).join(poly, "poly").groupBy(F.col("id").alias("obj_id")).agg(F.min(F.struct((-F.col("label")).alias("deep"), F.col("poly"), F.col("label"))).alias("s"))
    return best.select("obj_id", "s.label", F.col("s.poly").alias("poly_id"))


@query("""WITH e AS (SELECT poly_id, ex_i, unnest(pts) AS a, unnest(list_append(pts[2:], pts[1])) AS b FROM (SELECT poly_id, ex_i, ring AS pts FROM {POLY} UNION ALL SELECT poly_id, ex_i, unnest(holes) FROM {POLY} WHERE holes IS NOT NULL) WHERE len(pts) > 2),
t AS (SELECT p.obj_id, e.poly_id, p.x, p.y, e.a.x AS ax, e.a.y AS ay, e.b.x - e.a.x AS dx, e.b.y - e.a.y AS dy FROM {PTS} p JOIN e USING (ex_i)),
s AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) END AS u FROM t),
o AS (SELECT obj_id, poly_id, min(sqrt(pow(x - ax - u * dx, 2) + pow(y - ay - u * dy, 2))) AS d FROM s GROUP BY ALL),
b AS (SELECT obj_id, poly_id, d FROM o UNION ALL SELECT obj_id, poly_id, 0 FROM {INSIDE})
SELECT obj_id, poly_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY d, poly_id) AS k FROM b) WHERE k = 1""")
def nearest_polygon(spark: SparkSession, d: str) -> DataFrame:
    """The polygon of its example nearest to each object, however far; 0 inside. Objects of examples without polygons have no row."""
    out = n.nearest_outlines(points(spark, d), "obj_id", F.col("x"), F.col("y"), "ex_i", table(spark, d, "roi_polygons"), "poly_id", "ring", "holes", Cut(spark))
    every = out.unionAll(_inside(spark, d).select("id", "poly", F.lit(0.0).alias("distance")))
    return every.groupBy(F.col("id").alias("obj_id")).agg(F.min(F.struct("distance", "poly")).alias("s")).select("obj_id", F.col("s.poly").alias("poly_id"), F.round("s.distance", 6).alias("distance"))


def raster_lookup(spark: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    """Points meet the runs of their line, so that no place without a point is made. The merge join: Spark takes exploded rows for few."""
    at = points(spark, d).select("obj_id", "ex_i", F.rint(F.col("y") / grid.pitch).cast("long").alias("row"), F.rint(F.col("x") / grid.pitch).cast("long").alias("col"))
    runs = g.spans(polygons(spark, d), ["ex_i", "poly_id", "label"], "ring", grid.pitch, "holes" if grid.holes else None)
    met = at.join(runs.hint("merge"), ["ex_i", "row"], "left")
    here = (F.col("lo") <= F.col("col")) & (F.col("col") <= F.col("hi")) & ~g.in_hole(F.col("col"))
    return met.groupBy("obj_id").agg(F.coalesce(F.min(F.when(here, F.col("label"))), F.lit(0)).alias("roi"))


@query()
def polygonise(spark: SparkSession, d: str, grid: Grid = PIXELS) -> DataFrame:
    """Outlines of each polygon's mask along the edges of its pixels, those of its holes among them; every pixel counts."""

    def outlines(s: painted.Shapes) -> dict:
        shape, corners, y, x = painted.rings(s.apart(np.arange(len(s.number)), len(s.number)))
        ring = pa.ListArray.from_arrays(np.append(0, corners.cumsum()), pa.StructArray.from_arrays([pa.array(x.astype(float)), pa.array(y.astype(float))], ["x", "y"]))
        new = np.flatnonzero(np.append(True, shape[1:] != shape[:-1])[: len(shape)])
        _, number = painted.spread(np.diff(np.append(new, len(shape))))
        return {"ex_i": s.names.take(s.image[shape]), "poly_id": painted.numbers(s.number[shape]), "ring_no": number, "ring": ring}

    return painted.by_image(polygons(spark, d), "ex_i", "poly_id", "ring", "holes" if grid.holes else None, grid.pitch, outlines, f"ex_i string, poly_id long, ring_no int, ring {g.RING}")
