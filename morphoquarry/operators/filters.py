"""Predicates, range filters with counts, top-1 removal of duplicates, and label filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphoquarry.operators.twostage import with_percentiles

Range = tuple[float | None, float | None]


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that the table has, in the order asked for."""
    return [c for c in columns if c in df.columns]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def equals(**values) -> Column:
    """AND of equalities; None asks for NULL."""
    return reduce(lambda a, b: a & b, [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in values.items()], F.lit(True))


def pick(df: DataFrame, column: str | None = None, **values) -> DataFrame:
    """Rows with these values, or one column of them."""
    rows = df.where(equals(**values))
    return rows.select(column) if column else rows


def in_range(column: str | Column, bounds: Range, inclusive: bool = False) -> Column:
    """Whether a value lies in the range; None is open. Values that are NULL or NaN lie in no range with a bound."""
    c = F.col(column) if isinstance(column, str) else column
    low, high = bounds
    low = None if low in (-1, "inf", "-inf") and not inclusive else low
    tests = []
    if low is not None:
        tests.append(c >= low if inclusive else c > low)
    if high is not None and high not in (-1, "inf"):
        tests.append(c <= high if inclusive else c < high)
    if not tests:
        return F.lit(True)
    # NULL fails any comparison; NaN counts as greater than all numbers, so it must be told off where nothing bounds it above
    return reduce(lambda a, b: a & b, tests) & ~F.isnan(c.cast("double"))


def all_in_range(ranges: dict[str, Range], inclusive: bool = False) -> Column:
    return reduce(lambda a, b: a & b, [in_range(c, r, inclusive) for c, r in ranges.items()], F.lit(True))


def range_filter(df: DataFrame, ranges: dict[str, Range], inclusive: bool = False) -> DataFrame:
    return df.where(all_in_range(ranges, inclusive))


def range_counts(df: DataFrame, ranges: dict[str, Range], keys: list[str] = [], inclusive: bool = False) -> DataFrame:  # noqa: B006
    """Rows before any filter and after each further one, in one pass: pre_filters, post_{column}."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("pre_filters")]
    for c, r in ranges.items():
        passed = passed & in_range(c, r, inclusive)
        counts.append(F.count(F.when(passed, 1)).alias(f"post_{c}"))
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def spread_thresholds(thresholds: dict, ids: list[int]) -> dict[int, dict[str, Range]]:
    """Ranges by id from global ones and those under an id (number or text); an id's own range wins."""
    shared = {k: tuple(v) for k, v in thresholds.items() if not isinstance(v, dict)}
    own = {int(k): {p: tuple(r) for p, r in v.items()} for k, v in thresholds.items() if isinstance(v, dict)}
    return {i: shared | own.get(i, {}) for i in ids}


def check_thresholds(df: DataFrame, thresholds: dict[int, dict[str, Range]]) -> None:
    """Raises KeyError if a threshold names a column the table lacks; columns ch<number>_intensity are exempt."""
    missing = sorted({p for ranges in thresholds.values() for p in ranges if p not in df.columns and not re.fullmatch(r"ch\d+_intensity", p)})
    if missing:
        raise KeyError(f"no such columns: {missing}")


def thresholds_by_id(df: DataFrame, id_col: str, thresholds: dict[int, dict[str, Range]]) -> DataFrame:
    """Rows of the ids named that lie in their id's ranges: one predicate, so no union of parts."""
    check_thresholds(df, thresholds)
    tests = [(F.col(id_col) == i) & reduce(lambda a, b: a & b, [in_range(c, r) for c, r in ranges.items() if c in df.columns], F.lit(True)) for i, ranges in thresholds.items()]
    return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per key by an order that must be total for a repeatable result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_mq_rank", rank).where(F.col("_mq_rank") <= n).drop("_mq_rank")


def best_match_only(df: DataFrame, group: list[str], match: str, metric: str, label: str, largest: bool = True) -> DataFrame:
    """Of rows that claim the same match, the one with the best metric; ties go to the smaller label. Rows without a match stay."""
    order = F.col(metric).desc_nulls_last() if largest else F.col(metric).asc_nulls_last()
    return df.where(F.col(match).isNull()).unionByName(top_per_key(df.where(F.col(match).isNotNull()), [*group, match], [order, F.col(label)]))


def surviving_children(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def filter_objects(df: DataFrame, thresholds: dict[int, dict[str, Range]], specs: dict[int, list[int]], keys: list[str], id_col: str, label: str, match: str, metric: str) -> DataFrame:
    """Objects that pass their id's ranges; of composite ids only the best per match, and only where every parent survived.

    ``specs``: composite id → the ids it is made of. Parents are handled before composites, level by level, whatever
    the order in which they are given. Distinct objects are expected; rows with NULL in a key have no surviving parent.
    """
    passed = thresholds_by_id(df, id_col, thresholds)
    done = {i: passed.where(F.col(id_col) == i) for i in thresholds if i not in specs}
    waiting = {i: parents for i, parents in specs.items() if i in thresholds}
    while waiting:
        ready = [i for i, parents in waiting.items() if not set(parents) & set(waiting)]
        if not ready:
            raise ValueError(f"composite ids that need each other: {sorted(waiting)}")
        for i in ready:
            rows = best_match_only(passed.where(F.col(id_col) == i), keys, match, metric, label)
            base = waiting.pop(i)[-1]
            done[i] = surviving_children(rows, done[base], [*keys, label]) if base in done else rows
    return reduce(lambda a, b: a.unionByName(b), done.values())


def zero_filled_counts(df: DataFrame, id_col: str, ids: list[int]) -> DataFrame:
    """(id, n) for each id asked for, 0 where there is none."""
    every = df.sparkSession.createDataFrame([(int(i),) for i in ids], f"{id_col} long")
    return every.join(df.groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.count(F.lit(1)).alias("n")), id_col, "left").select(id_col, F.coalesce("n", F.lit(0)).alias("n"))


def mad_outliers(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows whose value is an outlier of its group by the MAD-median rule: |x − median| / (MAD / 0.6745) above √χ²(0.975, 1). No outliers where MAD is 0."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    away = with_percentiles(rows, keys, value, [0.5], "_q").withColumn("_away", F.abs(F.col(value) - F.col("_q")[0])).drop("_q")
    test = F.try_divide(F.col("_away") * 0.6745, F.col("_mad")[0]) > 2.241402727604945
    return with_percentiles(away, keys, "_away", [0.5], "_mad").where(F.coalesce(test, F.lit(False))).drop("_away", "_mad")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing but NULL; an empty table loses all of them."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])


def map_ranges(value: Column, mapping: dict) -> Column:
    """A number by exact value or (low, high) range, both ends included; later entries win; others stay. The original value is tested."""
    out = value
    for key, new in mapping.items():
        test = value.between(*key) if isinstance(key, tuple) else value == key
        out = F.when(test, F.lit(new)).otherwise(out)
    return out
