"""Long and wide forms, nested records and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def pivot_by_id(df: DataFrame, keys: list[str], id_col: str, ids: list[int], values: list[str]) -> DataFrame:
    """One row per key that the first id has, with columns {value}_ch{id}; of rows that share a key the largest value counts."""
    first = F.count(F.when(F.col(id_col) == ids[0], 1))
    wide = df.groupBy(*keys).agg(first.alias("_mq_first"), *[F.max(F.when(F.col(id_col) == i, F.col(v))).alias(f"{v}_ch{i}") for v in values for i in ids])
    return wide.where("_mq_first > 0").drop("_mq_first")


def flatten_structs(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns to columns named by their way, at any depth; clashing names get a number."""

    def walk(prefix: str, column: Column, kind: T.DataType):
        if isinstance(kind, T.StructType):
            for field in kind:
                yield from walk(f"{prefix}{sep}{field.name}" if prefix else field.name, column[field.name], field.dataType)
        else:
            yield prefix, column

    taken: dict[str, int] = {}
    out = []
    for field in df.schema:
        for name, column in walk(field.name, df[field.name], field.dataType):
            taken[name] = taken.get(name, 0) + 1
            out.append(column.alias(name if taken[name] == 1 else f"{name}{sep}{taken[name]}"))
    return df.select(*out)


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both; a new value wins unless it is NULL."""
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a)))


def first_pattern(text: Column, patterns: dict[str, str | None]) -> Column:
    """The value of the first pattern that the text matches; a pattern without a value gives the matched text; no match gives NULL."""
    hit = None
    for pattern, value in patterns.items():
        got = F.lit(value) if value is not None else F.regexp_extract(text, pattern, 0)
        hit = F.when(text.rlike(pattern), got) if hit is None else hit.when(text.rlike(pattern), got)
    return hit


def channel_options(text: Column) -> Column:
    """'A (pat) | B (pat)' as an array of (name, pattern)."""
    parts = F.filter(F.split(text, r"\s*\|\s*"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(p, r"\([^)]*\)", "")).alias("name"), F.regexp_extract(p, r"\(([^)]*)\)", 1).alias("pattern")))


def channel_suffix(name: Column) -> Column:
    """The number of '…_ch<number>', NULL without one."""
    return F.nullif(F.regexp_extract(name, r"_ch(\d+)$", 1), F.lit("")).cast("int")


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Between two arrays of numbers: euclidean, manhattan or chebyshev."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.transform(gaps, lambda g: g * g), F.lit(0.0), lambda s, g: s + g))
    if metric == "manhattan":
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    if metric == "chebyshev":
        return F.array_max(gaps)
    raise ValueError(metric)


def stars(p: Column) -> Column:
    """Significance marks; NULL and NaN have none."""
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.0001, "****").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def parse_list(text: Column) -> Column:
    """'[1, 2.5, None]' as an array of numbers."""
    return F.from_json(F.regexp_replace(F.regexp_replace(text, "None|nan|NaN", "null"), r"\s+", ""), "array<double>")
