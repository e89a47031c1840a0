"""Problem 1: neighbours of the same dendrite and the regions that hold an object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators.proximity import containing_polygons, near_pairs
from morphoquarry.sources.tables import table

RADIUS = 3.0


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "rpdf")
    rows = raw.count()
    c = F.col("centroid")
    whole = c.isNotNull() & F.size(c).between(2, 3) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    objects = raw.where((F.col("centroid_unit") == "px") & whole)
    x, y = F.element_at(c, -1), F.element_at(c, -2)
    z = F.when(F.size(c) == 3, c[0]).otherwise(F.lit(0.0))
    near = near_pairs(objects, "obj_id", [x, y, z], [F.col("ex_i"), F.col("colocal_id"), F.col("dend_id"), F.size(c)], RADIUS, rows=rows)
    inside = containing_polygons(objects, "obj_id", x, y, [F.col("ex_i")], table(spark, folder, "roi_polygons"), "poly_id", "ring", "holes", [F.col("ex_i")], rows=rows)
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionAll(inside.select(F.lit("inside").alias("kind"), F.col("id").alias("id_a"), F.col("poly").alias("id_b")))


QUERIES = {"p1_found": p1_found}
SQL = {
    "p1_found": """
WITH obj AS (SELECT DISTINCT obj_id, ex_i, colocal_id, dend_id, centroid, centroid[len(centroid)] AS x, centroid[len(centroid)-1] AS y FROM rpdf
  WHERE centroid_unit = 'px' AND centroid IS NOT NULL AND len(centroid) BETWEEN 2 AND 3
    AND len(list_filter(centroid, lambda v: v IS NULL OR isnan(v))) = 0),
poly AS (SELECT DISTINCT poly_id, ex_i, ring, coalesce(holes, []) AS holes FROM roi_polygons WHERE ring IS NOT NULL),
rings AS (SELECT poly_id, ex_i, 0 AS r, ring AS pts FROM poly
  UNION ALL SELECT poly_id, ex_i, unnest(range(1, len(holes) + 1)) AS r, unnest(holes) AS pts FROM poly),
edges AS (SELECT poly_id, ex_i, r, unnest(pts) AS a, unnest(list_append(pts[2:], pts[1])) AS b FROM rings WHERE len(pts) > 2),
odd AS (SELECT obj_id, poly_id, r FROM obj JOIN edges e USING (ex_i)
  WHERE (e.a.y <= obj.y) <> (e.b.y <= obj.y) AND obj.x < e.a.x + (obj.y - e.a.y) * (e.b.x - e.a.x) / (e.b.y - e.a.y)
  GROUP BY obj_id, poly_id, r HAVING count(*) % 2 = 1)
SELECT 'near' AS kind, a.obj_id AS id_a, b.obj_id AS id_b FROM obj a JOIN obj b
  ON a.ex_i = b.ex_i AND a.colocal_id = b.colocal_id AND a.dend_id = b.dend_id AND a.obj_id < b.obj_id AND len(a.centroid) = len(b.centroid)
  WHERE list_distance(a.centroid, b.centroid) <= 3.0
UNION ALL SELECT 'inside', obj_id, poly_id FROM odd GROUP BY obj_id, poly_id HAVING min(r) = 0 AND max(r) = 0"""
}
