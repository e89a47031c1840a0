"""Window operators: scores within groups, percentile bands, ranks, corrected p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphoquarry.operators.twostage import carried, parted, ranked, shuffled_rank, stable, with_percentiles, with_statistics


def zscore(df: DataFrame, value: str, keys: list[str], out: str = "z", zero_if_constant: bool = False) -> DataFrame:
    """Adds the distance to the group's mean in sample deviations; NULL, or 0 on request, where the deviation is 0 or unknown."""
    rows = with_statistics(df, keys, {"_m": F.avg(value), "_d": F.stddev_samp(value)})
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_d"))
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), F.coalesce(z, F.lit(0.0))) if zero_if_constant else z).drop("_m", "_d")


def median_distance(df: DataFrame, value: str, keys: list[str], out: str = "away") -> DataFrame:
    rows = with_percentiles(df, keys, value, [0.5], "_q")
    return rows.withColumn(out, F.abs(F.col(value) - F.col("_q")[0])).drop("_q")


def band_rows(df: DataFrame, value: str, keys: list[str], bands: dict[str, tuple[float | None, float | None, str]]) -> DataFrame:
    """Rows once for each band that holds them, with its name in ``band``.

    A band is (low share, high share, closed) with closed one of 'low', 'high', 'both', 'neither'; None is open. The
    limits are interpolated percentiles of the group. Rows without a value are in no band.
    """
    shares = sorted({q for lo, hi, _ in bands.values() for q in (lo, hi) if q is not None})
    at = with_percentiles(df.where(F.col(value).isNotNull()), keys, value, shares, "_mq_q")
    limit = lambda q: F.col("_mq_q")[shares.index(q)]
    tests = []
    for name, (lo, hi, closed) in bands.items():
        test = F.lit(True)
        if lo is not None:
            test &= F.col(value) >= limit(lo) if closed in ("low", "both") else F.col(value) > limit(lo)
        if hi is not None:
            test &= F.col(value) <= limit(hi) if closed in ("high", "both") else F.col(value) < limit(hi)
        tests.append(F.when(test, F.lit(name)))
    return at.withColumn("band", F.explode(F.array_compact(F.array(*tests)))).drop("_mq_q")


def ecdf(df: DataFrame, value: str, keys: list[str], out: str = "ecdf") -> DataFrame:
    """Adds the share of the group's values that are not greater."""
    rows = ranked(df.where(F.col(value).isNotNull()), keys, value, "_r")
    upto = F.col("_r") + (F.col("_ties") - 1) / 2
    return with_statistics(rows, keys, {"_n": F.count(F.lit(1))}).withColumn(out, upto / F.col("_n")).drop("_r", "_ties", "_n")


def representatives(df: DataFrame, subject: str, within: list[str], values: list[str], n: int) -> DataFrame:
    """(within, subject, mean_distance, rank): the n subjects whose values lie nearest to their group's medians, by z-scores."""
    long = df.unpivot([subject, *within], values, "variable", "value").where("value IS NOT NULL")
    scored = stable(zscore(long, "value", [*within, "variable"], zero_if_constant=True))
    away = median_distance(scored, "z", [*within, "variable"]).groupBy(*within, subject).agg(F.avg("away").alias("mean_distance"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.round("mean_distance", 9), subject))
    return away.withColumn("rank", rank).where(F.col("rank") <= n)


def adjusted(df: DataFrame, p: str, keys: list[str], method: str = "fdr_bh", out: str = "q") -> DataFrame:
    """Adds p-values corrected for the number of tests per key: Benjamini–Hochberg or Bonferroni; NULL and NaN are no tests."""
    df = stable(df)
    real = F.col(p).isNotNull() & ~F.isnan(p)
    tests = with_statistics(df.where(real).withColumn("_p", F.col(p)), keys, {"_m": F.count(F.lit(1))})
    rest = df.where(~F.coalesce(real, F.lit(False))).withColumn(out, F.lit(None).cast("double"))
    if method == "bonferroni":
        done = tests.withColumn(out, F.least(F.col("_p") * F.col("_m"), F.lit(1.0)))
    elif method == "fdr_bh":
        ranks = ranked(tests, keys, "_p", "_r")
        raw = parted(ranks.withColumn("_raw", F.col("_p") * F.col("_m") / (F.col("_r") + (F.col("_ties") - 1) / 2)), keys, "_p")
        later = carried(raw, keys, {"_later": F.min("_raw")}, descending=True, how=F.min)
        here = F.min("_raw").over(Window.partitionBy(*keys, "_range").orderBy(F.col("_p").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        done = later.withColumn(out, F.least(here, F.col("_later"), F.lit(1.0)))
    else:
        raise ValueError(method)
    return done.select(*df.columns, out).unionByName(rest)


def shuffled_within(df: DataFrame, value: str, keys: list[str], order: list[str], seed: int, out: str) -> DataFrame:
    """Adds the values of the group in a random order that the seed and the rows fix; a permutation of each group."""
    mine = shuffled_rank(df, keys, order, seed, "_mq_k")
    other = shuffled_rank(df, keys, order, seed + 1, "_k2").select(*[F.col(k).alias(f"_mq_{k}") for k in keys], F.col(value).alias(out), F.col("_k2").alias("_mq_k2"))
    on = [F.col(k).eqNullSafe(F.col(f"_mq_{k}")) for k in keys] + [F.col("_mq_k") == F.col("_mq_k2")]
    return mine.join(other, on).drop("_mq_k", "_mq_k2", *[f"_mq_{k}" for k in keys])


def equal_samples(df: DataFrame, keys: list[str], order: list[str], seed: int) -> DataFrame:
    """As many random rows of each group as the smallest group has."""
    least = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    return shuffled_rank(df, keys, order, seed, "_mq_r").where(F.col("_mq_r") <= least).drop("_mq_r")
