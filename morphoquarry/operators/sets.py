"""Unions, exceptions and precedence between populations of objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded_union(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def spec_table(spark, specs: dict[int, list[int]]) -> DataFrame:
    """(colocal_id, co_ids, base_id) of composite ids; the base is the last of the list."""
    return spark.createDataFrame([(i, list(ids), ids[-1]) for i, ids in specs.items()], "colocal_id long, co_ids array<long>, base_id long")


def inherited_ids(specs: DataFrame) -> DataFrame:
    """(colocal_id, inherited_id): the base and the smaller composites of the same base that a composite includes."""
    mine, other = specs.alias("m"), specs.alias("o")
    within = (F.col("m.base_id") == F.col("o.base_id")) & (F.col("m.colocal_id") != F.col("o.colocal_id"))
    pairs = mine.join(other, within).where(F.size(F.array_except("o.co_ids", "m.co_ids")) == 0).select(F.col("m.colocal_id"), F.col("o.colocal_id").alias("inherited_id"))
    return specs.select("colocal_id", F.col("base_id").alias("inherited_id")).union(pairs)


def separate_populations(df: DataFrame, specs: dict[int, list[int]], keys: list[str], id_col: str, label: str) -> DataFrame:
    """Each object in its most inclusive population only: rows of a base or a smaller composite go if a larger one has their label.

    Rows with NULL in a key or label stay.
    """
    table = inherited_ids(spec_table(df.sparkSession, specs))
    gone = df.join(F.broadcast(table), df[id_col] == table["colocal_id"]).select(*[df[k] for k in keys], F.col("inherited_id").alias(id_col), df[label]).distinct()
    return df.join(gone, [*keys, id_col, label], "left_anti")


def unmatched_composites(df: DataFrame, specs: dict[int, list[int]], keys: list[str], id_col: str, label: str) -> DataFrame:
    """Composite rows whose label no base row has: empty in sound tables."""
    base = F.broadcast(spec_table(df.sparkSession, specs).select(F.col("colocal_id").alias("_id"), "base_id"))
    rows = df.join(base, df[id_col] == F.col("_id")).select(*[df[c] for c in df.columns], "base_id")
    have = df.select(*keys, F.col(id_col).alias("base_id"), label).distinct()
    return rows.join(have, [*keys, "base_id", label], "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key by the order, in which equal rows may tie."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_mq_rank", rank).where("_mq_rank = 1").drop("_mq_rank")


def replace_partitions(df: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of newer in place of all rows of df with the same keys."""
    return df.join(newer.select(*keys).distinct(), keys, "left_anti").unionByName(newer, allowMissingColumns=True)


def replicate_rows(df: DataFrame, id_col: str, copies: dict[int, list[int]]) -> DataFrame:
    """Rows and, for an id named, copies of its rows under further ids."""
    further = F.lit(None).cast("array<long>")
    for i, ids in copies.items():
        further = F.when(F.col(id_col) == i, F.array(F.lit(i).cast("long"), *[F.lit(x).cast("long") for x in ids])).otherwise(further)
    return df.withColumn(id_col, F.explode(F.coalesce(further, F.array(F.col(id_col).cast("long")))))


def subtract(add: list[Column], remove: list[Column]) -> Column:
    """Whether any of add and none of remove holds."""
    return reduce(lambda a, b: a | b, add, F.lit(False)) & ~reduce(lambda a, b: a | b, remove, F.lit(False))
