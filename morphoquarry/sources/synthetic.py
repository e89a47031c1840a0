"""Seeded object tables for tests and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def example_objects(spark: SparkSession, rows: int = 10_000, seed: int = 0, shares: tuple[float, ...] = (0.2, 0.35, 0.3, 0.1, 0.05)) -> DataFrame:
    """Objects with ids drawn by the given shares: obj_id, ex_i, colocal_id, label, area, intensity_mean, intersection_percent; the two last ids are composites."""
    bound, tests = 0.0, None
    for i, s in enumerate(shares):
        bound += s
        tests = F.when(F.col("u") < bound, i) if tests is None else tests.when(F.col("u") < bound, i)
    base = spark.range(rows).select((F.col("id") + 1).alias("obj_id"), F.rand(seed).alias("u"))
    ids = base.withColumn("colocal_id", tests.otherwise(len(shares) - 1).cast("long"))
    return ids.select("obj_id", F.concat(F.lit("ex"), F.pmod("obj_id", F.lit(10))).alias("ex_i"), "colocal_id", F.col("obj_id").alias("label"), (F.floor(F.rand(seed + 1) * 1000) + 1).cast("double").alias("area"), (F.rand(seed + 2) * 65535).alias("intensity_mean"), F.when(F.col("colocal_id") >= len(shares) - 2, F.rand(seed + 3)).alias("intersection_percent"))
