"""Summaries, roll-ups, shares and raster aggregates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import aggregate as a
from morphoquarry.operators import geometry as g
from morphoquarry.operators.filters import top_per_key
from morphoquarry.operators.hierarchy import closure, hierarchy
from morphoquarry.operators.twostage import percentiles
from morphoquarry.sources.tables import OBJECTS_SQL, objects, table

QUERIES, SQL = {}, {}
PITCH = 8.0


class Grid(NamedTuple):
    """Places at which polygons are rasterised, and whether holes are left out."""

    pitch: float
    holes: bool


#: A coarse grid of places for set operations on labels: every eighth row and column, holes filled. plans/pixels.py has every pixel.
COARSE = Grid(PITCH, False)
PIXELS = Grid(1.0, True)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.replace("{OBJ}", OBJECTS_SQL).replace("{POLY}", POLY_SQL).replace("{VOX}", VOXELS_SQL)
        return fn

    return add


def polygons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roi_polygons").dropDuplicates(["poly_id"])


POLY_SQL = "(SELECT DISTINCT poly_id, ex_i, label, sub_idx, channel, ring, holes FROM roi_polygons)"


def voxels(spark: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    """Places of a grid inside each polygon's ring: (ex_i, poly_id, label, y, x)."""
    return g.raster(polygons(spark, d), ["ex_i", "poly_id", "label"], "ring", grid.pitch, "holes" if grid.holes else None)


VOXELS_SQL = f"""(WITH e AS (SELECT ex_i, poly_id, label, unnest(ring) AS a, unnest(list_append(ring[2:], ring[1])) AS b FROM {POLY_SQL} WHERE len(ring) > 2),
v AS (SELECT ex_i, poly_id, label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM e WHERE a.y <> b.y),
l AS (SELECT *, unnest(range(CAST(ceil(least(y1, y2) / {PITCH}) AS BIGINT), CAST(ceil(greatest(y1, y2) / {PITCH}) AS BIGINT))) AS r FROM v),
c AS (SELECT ex_i, poly_id, label, r, x1 + (r * {PITCH} - y1) * (x2 - x1) / (y2 - y1) AS cx FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY ex_i, poly_id, label, r ORDER BY cx) AS n FROM c),
s AS (SELECT p.ex_i, p.poly_id, p.label, p.r, p.cx AS lo, q.cx AS hi FROM k p JOIN k q ON p.poly_id = q.poly_id AND p.ex_i = q.ex_i AND p.label = q.label AND p.r = q.r AND q.n = p.n + 1 WHERE p.n % 2 = 1)
SELECT DISTINCT ex_i, poly_id, label, r * {PITCH} AS y, unnest(range(CAST(ceil(lo / {PITCH}) AS BIGINT), CAST(ceil(hi / {PITCH}) AS BIGINT))) * {PITCH} AS x FROM s)"""
AREA_SQL = """(SELECT poly_id, ex_i, label, abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y))) / 2 AS ring_area,
coalesce(list_sum(list_transform(coalesce(holes, []), lambda h: abs(list_sum(list_transform(range(1, len(h) + 1), lambda i: h[i].x * h[i % len(h) + 1].y - h[i % len(h) + 1].x * h[i].y))) / 2)), 0) AS hole_area FROM {POLY} WHERE len(ring) > 2)"""


@query(f"SELECT poly_id, ex_i, round(ring_area, 4) AS ring_area, round(ring_area - hole_area, 4) AS area FROM {AREA_SQL}")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    ring = F.col("ring")
    return polygons(spark, d).where(F.size(ring) > 2).select("poly_id", "ex_i", F.round(g.ring_area(ring), 4).alias("ring_area"), F.round(g.polygon_area(ring, F.col("holes")), 4).alias("area"))


@query(f"""SELECT o.ex_i, o.roi_i, o.colocal_id, o.n, round(o.intensity_mean, 6) AS intensity_mean, round(r.area, 4) AS roi_area, round(CASE WHEN r.area = 0 THEN NULL ELSE o.n / r.area END, 9) AS count_per_area
FROM (SELECT ex_i, roi_i, colocal_id, count(*) AS n, avg(intensity_mean) AS intensity_mean FROM {{OBJ}} WHERE ex_i IS NOT NULL AND roi_i IS NOT NULL GROUP BY ALL) o
LEFT JOIN (SELECT ex_i, label, sum(ring_area - hole_area) AS area FROM {AREA_SQL} GROUP BY ALL) r ON r.ex_i = o.ex_i AND r.label = o.roi_i""")
def summary_density(spark: SparkSession, d: str) -> DataFrame:
    rows = objects(spark, d)
    counts = a.summarise(rows, ["ex_i", "roi_i", "colocal_id"], ["intensity_mean"], "n")
    regions = polygons(spark, d).where(F.size("ring") > 2).groupBy("ex_i", F.col("label").alias("roi_i")).agg(F.sum(g.polygon_area(F.col("ring"), F.col("holes"))).alias("roi_area"))
    out = a.density(counts, regions, ["ex_i", "roi_i"], "roi_area", "n")
    return out.select("ex_i", "roi_i", "colocal_id", "n", F.round("intensity_mean", 6).alias("intensity_mean"), F.round("roi_area", 4).alias("roi_area"), F.round("count_per_area", 9).alias("count_per_area"))


@query("""SELECT animal_number, colocal_id, sum(n) AS n, round(sum(m * n) FILTER (m IS NOT NULL) / sum(n) FILTER (m IS NOT NULL), 6) AS intensity_mean
FROM (SELECT ex_i, colocal_id, count(*) AS n, avg(intensity_mean) AS m FROM {OBJ} GROUP BY ALL) JOIN exmd USING (ex_i) GROUP BY ALL""".replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n"))
def weighted_mean_rollup(spark: SparkSession, d: str) -> DataFrame:
    per = objects(spark, d).groupBy("ex_i", "colocal_id").agg(F.count(F.lit(1)).alias("n"), F.avg("intensity_mean").alias("intensity_mean"))
    rows = per.join(table(spark, d, "exmd").select("ex_i", "animal_number"), "ex_i")
    return a.weighted_means(rows, ["animal_number", "colocal_id"], ["n"], ["intensity_mean"], "n").withColumn("intensity_mean", F.round("intensity_mean", 6))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree of ids."""
    top = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(None).cast("long").alias("up"))
    mid = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("up"))
    low = table(spark, d, "customer").select((F.col("c_custkey") + 10000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("up"))
    return top.unionAll(mid).unionAll(low)


CLOSURE_SQL = """(SELECT r_regionkey + 1 AS ancestor, r_regionkey + 1 AS descendant FROM region UNION ALL SELECT n_nationkey + 1000, n_nationkey + 1000 FROM nation UNION ALL SELECT n_regionkey + 1, n_nationkey + 1000 FROM nation
UNION ALL SELECT c_custkey + 10000, c_custkey + 10000 FROM customer UNION ALL SELECT c_nationkey + 1000, c_custkey + 10000 FROM customer UNION ALL SELECT n_regionkey + 1, c_custkey + 10000 FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"SELECT CAST(ancestor AS BIGINT) AS ancestor, CAST(descendant AS BIGINT) AS descendant FROM {CLOSURE_SQL}")
def tree_closure(spark: SparkSession, d: str) -> DataFrame:
    return closure(hierarchy(_tree(spark, d), "id", "up")).select("ancestor", "descendant")


@query(f"""WITH c AS {CLOSURE_SQL}, o AS (SELECT o_orderstatus, o_custkey + 10000 AS region, o_totalprice FROM orders),
s AS (SELECT o_orderstatus, ancestor, count(*) AS n, avg(o_totalprice) AS m FROM o JOIN c ON c.descendant = o.region GROUP BY ALL)
SELECT p.o_orderstatus, CAST(r.ancestor AS BIGINT) AS region, coalesce(s.n, 0) AS "count", round(s.m, 4) AS o_totalprice FROM (SELECT DISTINCT o_orderstatus FROM o) p CROSS JOIN (SELECT DISTINCT ancestor FROM c) r
LEFT JOIN s ON s.o_orderstatus = p.o_orderstatus AND s.ancestor = r.ancestor""")
def tree_rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    links = closure(hierarchy(_tree(spark, d), "id", "up"))
    orders = table(spark, d, "orders").select("o_orderstatus", (F.col("o_custkey") + 10000).alias("region"), "o_totalprice")
    return a.roll_up(orders, links, "region", ["o_orderstatus"], ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("""SELECT ex_i, roi_i FROM (SELECT ex_i, roi_i, row_number() OVER (PARTITION BY ex_i ORDER BY count(*) DESC, roi_i) AS k FROM {OBJ} WHERE roi_i IS NOT NULL GROUP BY ex_i, roi_i) WHERE k = 1""")
def largest_group_only(spark: SparkSession, d: str) -> DataFrame:
    return a.largest_group(objects(spark, d), ["ex_i"], "roi_i")


@query("""SELECT colocal_id, round(avg(cov), 8) AS mean_cov FROM (SELECT colocal_id, dend_id, CASE WHEN avg(intensity_mean) = 0 THEN NULL ELSE stddev_samp(intensity_mean) / avg(intensity_mean) END AS cov FROM {OBJ} WHERE dend_id IS NOT NULL GROUP BY ALL) GROUP BY colocal_id""")
def cov_two_level(spark: SparkSession, d: str) -> DataFrame:
    per = objects(spark, d).where("dend_id IS NOT NULL").groupBy("colocal_id", "dend_id").agg(a.variation(F.col("intensity_mean")).alias("cov"))
    return per.groupBy("colocal_id").agg(F.round(F.avg("cov"), 8).alias("mean_cov"))


@query("""SELECT event_type, q AS share, round(quantile_cont(value, q), 6) AS value FROM events, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) t(q) GROUP BY event_type, q""".replace("quantile_cont(value, q)", "CASE q WHEN 0.05 THEN quantile_cont(value, 0.05) WHEN 0.25 THEN quantile_cont(value, 0.25) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.75 THEN quantile_cont(value, 0.75) ELSE quantile_cont(value, 0.95) END").replace("q AS share", "CAST(q AS DOUBLE) AS share"))
def quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    q = percentiles(table(spark, d, "events"), ["event_type"], "value", shares, "v")
    return q.select("event_type", F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("s"), F.col("v"))).alias("z")).select("event_type", F.col("z.s").alias("share"), F.round("z.v", 6).alias("value"))


@query("""SELECT colocal_id, roi_i, round(n / sum(n) OVER (PARTITION BY colocal_id), 9) AS share FROM (SELECT colocal_id, roi_i, count(*) AS n FROM {OBJ} GROUP BY ALL)""")
def normalised_value_counts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = objects(spark, d).groupBy("colocal_id", "roi_i").agg(F.count(F.lit(1)).alias("n"))
    return n.select("colocal_id", "roi_i", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("colocal_id")), 9).alias("share"))


@query("""SELECT is_puncta, genotype, count(*) AS n, count(DISTINCT ex_i) AS n_examples, round(count(*) / sum(count(*)) OVER (PARTITION BY genotype), 9) AS proportion FROM (SELECT DISTINCT synapse_id, ex_i, genotype, is_puncta FROM synapse_features) GROUP BY is_puncta, genotype""")
def cluster_composition(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "synapse_features").select("synapse_id", "ex_i", "genotype", "is_puncta").distinct()
    n = rows.groupBy("is_puncta", "genotype").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ex_i").alias("n_examples"))
    return n.withColumn("proportion", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("genotype")), 9))


@query("""WITH s AS (SELECT DISTINCT treatment, animal_number FROM exmd), o AS (SELECT treatment, animal_number, intensity_mean FROM {OBJ} JOIN exmd USING (ex_i) WHERE colocal_id = 0 AND intensity_mean IS NOT NULL)
SELECT s.treatment, s.animal_number, round(coalesce(avg(CASE WHEN o.intensity_mean > 1000 THEN 1.0 ELSE 0.0 END) FILTER (o.intensity_mean IS NOT NULL), 0), 9) AS proportion FROM s LEFT JOIN o ON o.treatment IS NOT DISTINCT FROM s.treatment AND o.animal_number IS NOT DISTINCT FROM s.animal_number GROUP BY ALL""")
def proportion_beyond(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "exmd").select("ex_i", "treatment", "animal_number")
    rows = objects(spark, d).where("colocal_id = 0 AND intensity_mean IS NOT NULL").join(meta, "ex_i").groupBy("treatment", "animal_number").agg(F.avg(F.when(F.col("intensity_mean") > 1000, 1.0).otherwise(0.0)).alias("p"))
    scaffold = meta.select(F.col("treatment").alias("t"), F.col("animal_number").alias("n")).distinct()
    out = scaffold.join(rows, F.col("t").eqNullSafe(F.col("treatment")) & F.col("n").eqNullSafe(F.col("animal_number")), "left")
    return out.select(F.col("t").alias("treatment"), F.col("n").alias("animal_number"), F.round(F.coalesce("p", F.lit(0.0)), 9).alias("proportion"))


@query("""SELECT count(*) FILTER (genotype = 'KO' AND is_puncta) AS ko_yes, count(*) FILTER (genotype = 'KO' AND NOT is_puncta) AS ko_no, count(*) FILTER (genotype = 'WT' AND is_puncta) AS wt_yes, count(*) FILTER (genotype = 'WT' AND NOT is_puncta) AS wt_no
FROM (SELECT DISTINCT synapse_id, genotype, is_puncta FROM synapse_features)""")
def contingency_2x2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "synapse_features").select("synapse_id", "genotype", "is_puncta").distinct()
    cell = lambda g_, yes: F.count(F.when((F.col("genotype") == g_) & (F.col("is_puncta") if yes else ~F.col("is_puncta")), 1))
    return rows.agg(cell("KO", True).alias("ko_yes"), cell("KO", False).alias("ko_no"), cell("WT", True).alias("wt_yes"), cell("WT", False).alias("wt_no"))


@query("""WITH s AS (SELECT DISTINCT synapse_id, genotype, intensity_mean, area, eccentricity FROM synapse_features WHERE intensity_mean IS NOT NULL AND area IS NOT NULL AND eccentricity IS NOT NULL),
o AS (SELECT avg(intensity_mean) AS m1, stddev_pop(intensity_mean) AS d1, avg(area) AS m2, stddev_pop(area) AS d2, avg(eccentricity) AS m3, stddev_pop(eccentricity) AS d3 FROM s)
SELECT genotype, count(*) AS n, round((avg(intensity_mean) - any_value(m1)) / any_value(d1), 8) AS z_intensity_mean, round((avg(area) - any_value(m2)) / any_value(d2), 8) AS z_area, round((avg(eccentricity) - any_value(m3)) / any_value(d3), 8) AS z_eccentricity FROM s, o GROUP BY genotype""")
def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    features = ["intensity_mean", "area", "eccentricity"]
    rows = table(spark, d, "synapse_features").select("synapse_id", "genotype", *features).dropna(subset=features).distinct()
    return a.zscores_of_groups(rows, ["genotype"], features).select("genotype", "n", *[F.round(f"z_{c}", 8).alias(f"z_{c}") for c in features])


@query("""WITH s AS (SELECT DISTINCT synapse_id, genotype, intensity_mean, area, eccentricity FROM synapse_features WHERE intensity_mean IS NOT NULL AND area IS NOT NULL AND eccentricity IS NOT NULL),
o AS (SELECT avg(intensity_mean) AS m1, stddev_pop(intensity_mean) AS d1, avg(area) AS m2, stddev_pop(area) AS d2, avg(eccentricity) AS m3, stddev_pop(eccentricity) AS d3 FROM s),
z AS (SELECT genotype, (avg(intensity_mean) - any_value(m1)) / any_value(d1) AS intensity_mean, (avg(area) - any_value(m2)) / any_value(d2) AS area, (avg(eccentricity) - any_value(m3)) / any_value(d3) AS eccentricity FROM s, o GROUP BY genotype),
u AS (UNPIVOT z ON intensity_mean, area, eccentricity INTO NAME feature VALUE z)
SELECT genotype, feature, round(z, 8) AS z, k AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY genotype ORDER BY abs(z) DESC, feature) AS k FROM u) WHERE k <= 2""")
def top_driver_features(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    features = ["intensity_mean", "area", "eccentricity"]
    rows = table(spark, d, "synapse_features").select("synapse_id", "genotype", *features).dropna(subset=features).distinct()
    z = a.zscores_of_groups(rows, ["genotype"], features)
    long = z.select("genotype", *[F.col(f"z_{c}").alias(c) for c in features]).unpivot("genotype", features, "feature", "z")
    w = Window.partitionBy("genotype").orderBy(F.abs("z").desc(), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("genotype", "feature", F.round("z", 8).alias("z"), "rank")


@query("""SELECT colocal_id, round(avg(p3) / pow(avg(p2), 1.5), 6) AS skewness, round(avg(p4) / pow(avg(p2), 2) - 3, 6) AS kurtosis
FROM (SELECT colocal_id, pow(v - m, 2) AS p2, pow(v - m, 3) AS p3, pow(v - m, 4) AS p4 FROM (SELECT colocal_id, intensity_mean AS v, avg(intensity_mean) OVER (PARTITION BY colocal_id) AS m FROM {OBJ} WHERE intensity_mean IS NOT NULL)) GROUP BY colocal_id""")
def intensity_moments(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).groupBy("colocal_id").agg(F.round(F.skewness("intensity_mean"), 6).alias("skewness"), F.round(F.kurtosis("intensity_mean"), 6).alias("kurtosis"))


def rasterise(spark: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    return voxels(spark, d, grid).select("ex_i", "poly_id", "y", "x")


def axis_max_projection(spark: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    return voxels(spark, d, grid).groupBy("ex_i", "x").agg(F.max("label").alias("v"))


def label_extent(spark: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    ends = [f(c).cast("long").alias(f"{c}_{n}") for c in ("y", "x") for n, f in (("min", F.min), ("max", F.max))]
    return voxels(spark, d, grid).groupBy("ex_i", "label").agg(*ends)


def densest_tile(spark: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    tiles = voxels(spark, d, grid).groupBy("ex_i", F.floor(F.col("y") / 64).alias("ty"), F.floor(F.col("x") / 64).alias("tx")).agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(tiles, ["ex_i"], [F.col("n").desc(), F.col("ty"), F.col("tx")])
