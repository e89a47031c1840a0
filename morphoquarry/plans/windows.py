"""Scores within groups, bands, ranks, samples and corrected p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import windows as w
from morphoquarry.operators.filters import top_per_key
from morphoquarry.sources.tables import OBJECTS_SQL, objects, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.replace("{OBJ}", OBJECTS_SQL)
        return fn

    return add


@query("SELECT obj_id, round((intensity_mean - avg(intensity_mean) OVER p) / nullif(stddev_samp(intensity_mean) OVER p, 0), 6) AS z FROM {OBJ} WINDOW p AS (PARTITION BY dend_id, colocal_id)")
def zscore_in_group(spark: SparkSession, d: str) -> DataFrame:
    return w.zscore(objects(spark, d), "intensity_mean", ["dend_id", "colocal_id"]).select("obj_id", F.round("z", 6).alias("z"))


@query("SELECT obj_id, round(abs(intensity_mean - median(intensity_mean) OVER (PARTITION BY ex_i)), 6) AS away FROM {OBJ}")
def distance_to_median(spark: SparkSession, d: str) -> DataFrame:
    return w.median_distance(objects(spark, d), "intensity_mean", ["ex_i"]).select("obj_id", F.round("away", 6).alias("away"))


@query("""WITH q AS (SELECT obj_id, colocal_id, intensity_mean AS v, quantile_cont(intensity_mean, 0.25) OVER p AS a, quantile_cont(intensity_mean, 0.75) OVER p AS b FROM {OBJ} WHERE intensity_mean IS NOT NULL WINDOW p AS (PARTITION BY colocal_id))
SELECT obj_id, 'low' AS band FROM q WHERE v <= a UNION ALL SELECT obj_id, 'mid' FROM q WHERE v > a AND v < b UNION ALL SELECT obj_id, 'high' FROM q WHERE v >= b""")
def percentile_bands(spark: SparkSession, d: str) -> DataFrame:
    bands = {"low": (None, 0.25, "high"), "mid": (0.25, 0.75, "neither"), "high": (0.75, None, "low")}
    return w.band_rows(objects(spark, d), "intensity_mean", ["colocal_id"], bands).select("obj_id", "band")


@query("SELECT obj_id, ex_i, intensity_mean FROM (SELECT *, row_number() OVER (PARTITION BY ex_i ORDER BY intensity_mean DESC NULLS LAST, obj_id) AS k FROM {OBJ}) WHERE k <= 5")
def topn_per_group(spark: SparkSession, d: str) -> DataFrame:
    return top_per_key(objects(spark, d), ["ex_i"], [F.col("intensity_mean").desc_nulls_last(), F.col("obj_id")], 5).select("obj_id", "ex_i", "intensity_mean")


@query("""WITH s AS (SELECT ex_i, treatment, avg(intensity_mean) AS intensity_mean, avg(eccentricity) AS eccentricity FROM {OBJ} JOIN exmd USING (ex_i) WHERE treatment IS NOT NULL GROUP BY ALL),
u AS (SELECT ex_i, treatment, 'intensity_mean' AS variable, intensity_mean AS value FROM s WHERE intensity_mean IS NOT NULL UNION ALL SELECT ex_i, treatment, 'eccentricity', eccentricity FROM s WHERE eccentricity IS NOT NULL),
z AS (SELECT *, coalesce((value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0), 0) AS z FROM u WINDOW p AS (PARTITION BY treatment, variable)),
a AS (SELECT *, abs(z - median(z) OVER (PARTITION BY treatment, variable)) AS away FROM z), m AS (SELECT treatment, ex_i, avg(away) AS mean_distance FROM a GROUP BY ALL)
SELECT treatment, ex_i, round(mean_distance, 6) AS mean_distance, k AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY round(mean_distance, 9), ex_i) AS k FROM m) WHERE k <= 3""")
def representative_samples(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "exmd").select("ex_i", "treatment").where("treatment IS NOT NULL")
    per = objects(spark, d).join(meta, "ex_i").groupBy("ex_i", "treatment").agg(F.avg("intensity_mean").alias("intensity_mean"), F.avg("eccentricity").alias("eccentricity"))
    return w.representatives(per, "ex_i", ["treatment"], ["intensity_mean", "eccentricity"], 3).withColumn("mean_distance", F.round("mean_distance", 6))


@query("SELECT animal_number, genotype, round(count(*) / sum(count(*)) OVER (PARTITION BY animal_number), 9) AS proportion FROM exmd GROUP BY animal_number, genotype")
def proportion_of_total(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, d, "exmd").groupBy("animal_number", "genotype").agg(F.count(F.lit(1)).alias("n"))
    return n.select("animal_number", "genotype", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("animal_number")), 9).alias("proportion"))


@query("""WITH p AS (SELECT event_id, event_type, (value % 1.0 + 0.01) / 1.02 AS p FROM events), r AS (SELECT *, count(p) OVER (PARTITION BY event_type) AS m, count(p) OVER (PARTITION BY event_type ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM p WHERE p IS NOT NULL),
q AS (SELECT event_id, least(1.0, min(p * m / k) OVER (PARTITION BY event_type ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r) SELECT p.event_id, round(q, 6) AS q FROM p LEFT JOIN q USING (event_id)""")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "events").select("event_id", "event_type", ((F.col("value") % 1.0 + 0.01) / 1.02).alias("p"))
    return w.adjusted(tests, "p", ["event_type"]).select("event_id", F.round("q", 6).alias("q"))


@query("SELECT dend_id, count(*) AS n, round(sum(intensity_mean), 3) AS total FROM {OBJ} WHERE intensity_mean IS NOT NULL AND dend_id IS NOT NULL GROUP BY dend_id")
def shuffled_within_groups(spark: SparkSession, d: str) -> DataFrame:
    """A permutation keeps each group's number and total."""
    rows = objects(spark, d).where("intensity_mean IS NOT NULL AND dend_id IS NOT NULL").select("obj_id", "dend_id", "intensity_mean")
    out = w.shuffled_within(rows, "intensity_mean", ["dend_id"], ["obj_id"], 5, "shuffled")
    return out.groupBy("dend_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("shuffled"), 3).alias("total"))


@query("WITH n AS (SELECT genotype, count(*) AS n FROM exmd GROUP BY genotype) SELECT genotype, (SELECT min(n) FROM n) AS n FROM n")
def equal_downsampling(spark: SparkSession, d: str) -> DataFrame:
    return w.equal_samples(table(spark, d, "exmd").select("ex_i", "genotype"), ["genotype"], ["ex_i"], 3).groupBy("genotype").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT obj_id, round(cume_dist() OVER (PARTITION BY colocal_id ORDER BY intensity_mean), 9) AS ecdf FROM {OBJ} WHERE intensity_mean IS NOT NULL")
def ecdf(spark: SparkSession, d: str) -> DataFrame:
    return w.ecdf(objects(spark, d), "intensity_mean", ["colocal_id"]).select("obj_id", F.round("ecdf", 9).alias("ecdf"))


@query("""SELECT colocal_id, bin, round(100 * n / sum(n) OVER (PARTITION BY colocal_id), 6) AS percent FROM (SELECT colocal_id, CAST(floor(least(intensity_mean, 4999) / 250) AS BIGINT) AS bin, count(*) AS n FROM {OBJ} WHERE intensity_mean IS NOT NULL GROUP BY ALL)""")
def histogram_percent(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = objects(spark, d).where("intensity_mean IS NOT NULL").groupBy("colocal_id", F.floor(F.least("intensity_mean", F.lit(4999.0)) / 250).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("colocal_id", "bin", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("colocal_id")), 6).alias("percent"))
