"""Ranks, percentiles and running values of groups of any size.

A window over a group puts the group into one task. Here a group is parted by ranges of its values, cut at approximate
percentiles: each range is ranked alone, and small per-range totals, at most RANGES rows a group, carry over between
them. Statistics of a group are aggregated (with partial sums before the shuffle) and joined back; joins are left to
the optimiser, which broadcasts few groups and splits the partitions of a large one.

A plan may be run more than once in the process, so the values ranked must come out the same each time. Columns of
tables do; sums of floating numbers may differ in the last digit with the order of partial results. Pass such derived
values through ``stable`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphoquarry.session import Cut

#: Ranges into which a group's values are parted. Equal values share a range.
RANGES = 64


def stable(df: DataFrame) -> DataFrame:
    """The table as written once."""
    return Cut(df.sparkSession).table(df)


def joined_back(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's statistics; NULL keys are a group like others. Without keys the one row of statistics is put in as literals."""
    if not keys:
        one = stats.first()
        return df.withColumns({c: F.lit(one[c]) for c in stats.columns})
    other = stats.withColumnsRenamed({k: f"_mq_{k}" for k in keys})
    return df.join(other, [F.col(k).eqNullSafe(F.col(f"_mq_{k}")) for k in keys]).drop(*[f"_mq_{k}" for k in keys])


def with_statistics(df: DataFrame, keys: list[str], statistics: dict[str, Column]) -> DataFrame:
    """Adds aggregates of the row's group."""
    named = [c.alias(n) for n, c in statistics.items()]
    return joined_back(df, df.groupBy(*keys).agg(*named), keys)


def parted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``_range``, which ascends with the value within the key. Rows without a value must be left out before.

    The cuts are written first: approximate percentiles depend on the order in which partial results arrive, and all
    steps must part rows alike.
    """
    shares = [F.lit((i + 1) / RANGES) for i in range(RANGES - 1)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*shares), 1000).alias("_cuts"))
    return joined_back(df, stable(cuts), keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def carried(rows: DataFrame, keys: list[str], totals: dict[str, Column], descending: bool = False, how=F.sum) -> DataFrame:
    """Adds to rows with ``_range``, for each total of a range, what the ranges before it come to (after it if descending), under the same name."""
    per = rows.groupBy(*keys, "_range").agg(*[c.alias(n) for n, c in totals.items()])
    w = Window.partitionBy(*keys).orderBy(F.col("_range").desc() if descending else F.col("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, "_range", *[how(n).over(w).alias(n) for n in totals])
    return joined_back(rows, before, [*keys, "_range"])


def ranked(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Adds the average rank within the key (ties share it) and ``_ties``, the number of equal values."""
    rows = carried(parted(df, keys, value), keys, {"_below": F.count(F.lit(1))})
    first = F.rank().over(Window.partitionBy(*keys, "_range").orderBy(value))
    local = rows.withColumn("_first", first).withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_range", value)))
    return local.withColumn(out, F.coalesce("_below", F.lit(0)) + F.col("_first") + (F.col("_ties") - 1) / 2).drop("_below", "_first", "_range")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str = "percentiles") -> DataFrame:
    """(keys, out): exact, linearly interpolated percentiles as an array. Only values of the ranges that hold the wanted ranks are ordered.

    Values that are NULL or NaN don't count; a group without values has no row.
    """
    rows = parted(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v")), keys, "_v")
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    spans = counts.withColumns({"_n": F.sum("_c").over(w), "_to": F.sum("_c").over(w.orderBy("_range"))}).withColumn("_from", F.col("_to") - F.col("_c"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_n") - 1) * q).alias("p")) for i, q in enumerate(shares)])
    targets = spans.withColumn("w", F.explode(wanted)).withColumn("r", F.explode(F.array_distinct(F.array(F.floor("w.p"), F.ceil("w.p"))))).where("r >= _from AND r < _to")
    needed = targets.select(*keys, "_range").distinct()
    some = joined_back(rows, needed.withColumn("_need", F.lit(1)), [*keys, "_range"])
    local = some.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_v")) - 1)
    t = targets.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_range").alias("_t_range"), F.col("w.i").alias("i"), F.col("w.p").alias("p"), "r", (F.col("r") - F.col("_from")).alias("_at"))
    on = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys] + [F.col("_range") == F.col("_t_range"), F.col("_k") == F.col("_at")]
    found = local.join(t, on).select(*keys, "i", "p", "r", "_v")
    low, high = F.min_by("_v", "r"), F.max_by("_v", "r")
    each = found.groupBy(*keys, "i").agg((low + (high - low) * (F.max("p") - F.floor(F.max("p")))).alias("q"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias(out))


def with_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str) -> DataFrame:
    """Adds the percentiles of the row's group; NULL where the group has no values."""
    got = percentiles(df, keys, value, shares, out)
    if not keys:
        one = got.first()
        return df.withColumn(out, F.array(*[F.lit(v) for v in one[out]]) if one else F.lit(None).cast("array<double>"))
    other = got.withColumnsRenamed({k: f"_mq_{k}" for k in keys})
    return df.join(other, [F.col(k).eqNullSafe(F.col(f"_mq_{k}")) for k in keys], "left").drop(*[f"_mq_{k}" for k in keys])


def shuffled_rank(df: DataFrame, keys: list[str], order: list[str], seed: int, out: str) -> DataFrame:
    """Adds 1, 2, … per key in a random order that the seed and the columns of ``order`` fix; these must tell rows of a key apart."""
    drawn = df.withColumn("_draw", F.xxhash64(F.lit(seed), *[F.col(c) for c in order])).withColumn("_range", F.shiftrightunsigned("_draw", 58).cast("int"))
    rows = carried(drawn, keys, {"_below": F.count(F.lit(1))})
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_draw", *order))
    return rows.withColumn(out, (F.coalesce("_below", F.lit(0)) + local).cast("long")).drop("_draw", "_range", "_below")
