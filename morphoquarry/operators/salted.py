"""Per-key results when a few keys hold most rows: two-stage aggregation with salted heavy keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that names heavy keys; the result doesn't depend on it.
SAMPLE_ROWS = 50_000
#: Seed of the salts.
SEED = 23


@dataclass(frozen=True)
class Measure:
    """A statistic of ``value``: count, sum, avg, min, max or std (n − 1). NULL and NaN values don't count."""

    name: str
    kind: str
    value: Column

    def partial(self) -> list[Column]:
        v = F.nanvl(self.value.cast("double"), F.lit(None).cast("double")) if self.kind not in ("count", "min", "max") else F.when(self.value.isNotNull(), self.value)
        n = self.name
        if self.kind == "count":
            return [F.count(v).alias(f"{n}__n")]
        if self.kind in ("min", "max"):
            return [getattr(F, self.kind)(F.when(~F.isnan(v.cast("double")), v)).alias(f"{n}__v")]
        if self.kind == "sum":
            return [F.sum(v).alias(f"{n}__v")]
        parts = [F.count(v).alias(f"{n}__n"), F.avg(v).alias(f"{n}__m")]
        return parts + ([(F.var_pop(v) * F.count(v)).alias(f"{n}__q")] if self.kind == "std" else [])

    def merged(self) -> Column:
        n = self.name
        if self.kind == "count":
            return F.coalesce(F.sum(f"{n}__n"), F.lit(0)).cast("long").alias(n)
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(f"{n}__v").alias(n)
        if self.kind == "sum":
            return F.sum(f"{n}__v").alias(n)
        total = F.sum(f"{n}__n")
        first = F.sum(F.col(f"{n}__n") * F.col(f"{n}__m"))
        if self.kind == "avg":
            return F.try_divide(first, total).alias(n)
        second = F.sum(F.col(f"{n}__q") + F.col(f"{n}__n") * F.col(f"{n}__m") * F.col(f"{n}__m"))
        spread = F.greatest(second - F.try_divide(first * first, total), F.lit(0.0))
        return F.when(total > 1, F.sqrt(F.try_divide(spread, (total - 1).cast("double")))).alias(n)


def heavy_keys(df: DataFrame, key: str, rows: int, share: float) -> list:
    """Keys that hold at least ``share`` of a bounded sample: at most 1 / share of them."""
    fraction = min(1.0, SAMPLE_ROWS / max(rows, 1))
    sample = df.where(F.col(key).isNotNull()).select(key)
    if fraction < 1:
        sample = sample.sample(fraction, seed=7)
    total = max(1, min(rows, SAMPLE_ROWS))
    found = sample.groupBy(key).count().where(F.col("count") >= max(2, share * total)).orderBy(F.desc("count")).limit(int(1 / share) + 1).collect()
    return [r[0] for r in found]


def partials(df: DataFrame, key: str, measures: list[Measure], rows: int | None = None, salts: int = 32, share: float = 0.005) -> DataFrame:
    """First stage: one row per key, or per key and salt of a heavy key.

    The salt is drawn for each row, so rows that agree in all columns are spread too. A task that runs again reads the
    same rows in the same order and draws the same salts.
    """
    rows = df.count() if rows is None else rows
    heavy = heavy_keys(df, key, rows, share)
    spread = F.floor(F.rand(SEED) * salts).cast("int")
    salt = F.when(F.col(key).isin(heavy), spread).otherwise(0) if heavy else F.lit(0)
    parts = [c for m in measures for c in m.partial()]
    return df.withColumn("_mq_salt", salt).groupBy(F.col(key).alias("_mq_key"), "_mq_salt").agg(F.count(F.lit(1)).alias("_mq_rows"), *parts).withColumnRenamed("_mq_key", key)


def merge(parts: DataFrame, keys: list[str], measures: list[Measure], rows_name: str = "n_rows") -> DataFrame:
    """Second stage: partials (of salts, or of finer keys) to one row per key."""
    return parts.groupBy(*keys).agg(F.sum("_mq_rows").cast("long").alias(rows_name), *[m.merged() for m in measures])


def salted_aggregate(df: DataFrame, key: str, measures: list[Measure], rows: int | None = None, salts: int = 32, share: float = 0.005) -> DataFrame:
    """One row per non-NULL key with the number of its rows and the measures; repeated rows count as often as they occur.

    An empty table gives no rows. A key that holds a third of all rows is aggregated by ``salts`` tasks and merged from
    as many partials per input task at most.
    """
    return merge(partials(df.where(F.col(key).isNotNull()), key, measures, rows, salts, share), [key], measures)
