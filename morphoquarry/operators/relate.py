"""Small joins and columns of the object and example tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphoquarry.operators import runs as r


def keep_labels(df: DataFrame, keys: list[str], label: str, kept: DataFrame) -> DataFrame:
    """All rows, with 0 for labels that ``kept`` (keys, label) doesn't hold; NULL labels become 0 too. ``kept`` may repeat."""
    marked = kept.select(*keys, label).distinct().withColumn("_mq_kept", F.lit(True))
    return df.join(marked, [*keys, label], "left").withColumn(label, F.when(F.col("_mq_kept"), F.col(label)).otherwise(F.lit(0).cast(df.schema[label].dataType))).drop("_mq_kept").select(*df.columns)


def without_places(df: DataFrame, other: DataFrame, axes: list[str]) -> DataFrame:
    """Rows whose place is no place of ``other``; a NULL coordinate is never equal, so such rows stay."""
    return df.join(other.select(*axes), axes, "left_anti")


def merge_results(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of two tables of results; columns of the same name get _left and _right."""
    both = [c for c in left.columns if c in right.columns and c not in on]
    a, b = left.withColumnsRenamed({c: f"{c}_left" for c in both}), right.withColumnsRenamed({c: f"{c}_right" for c in both})
    return a.join(b, on, "full_outer")


def with_partner_properties(df: DataFrame, partners: DataFrame, keys: list[str], label: str, match: str, columns: list[str], prefix: str) -> DataFrame:
    """Adds the columns of the partner named in ``match`` under a prefix; NULL without one. ``partners`` must hold (keys, label) once."""
    other = partners.select(*keys, F.col(label).alias(match), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return df.join(other, [*keys, match], "left")


def scaffold_means(df: DataFrame, keys: list[str], row: str, column: str, value: str) -> DataFrame:
    """(keys, row, column, value, n): means for every pair of a row and a column that occur under the keys, 0 where they don't meet.

    A NULL ``row`` is the background, 0. The result is the product of the distinct rows and columns of each key, as wanted.
    """
    rows = df.withColumn(row, F.coalesce(F.col(row), F.lit(0).cast(df.schema[row].dataType))).where(F.col(column).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    means = rows.groupBy(*keys, row, column).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    every = rows.select(*keys, row).distinct().join(rows.select(*keys, column).distinct(), keys)
    return every.join(means, [*keys, row, column], "left").withColumns({value: F.coalesce(value, F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})


def path_parts(path: Column) -> dict[str, Column]:
    """folder, stem and suffix of a path with slashes or backslashes; NULL stays NULL, a name without a point has an empty suffix."""
    clean = F.regexp_replace(path, r"\\", "/")
    name = F.substring_index(clean, "/", -1)
    return {"folder": F.regexp_extract(clean, r"^(.*)/[^/]*$", 1), "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "suffix": F.regexp_extract(name, r"(\.[^.]*)$", 1)}


def padded_number(text: Column, width: int = 4) -> Column:
    """The first number of a text with leading zeros; NULL without one. Longer numbers stay whole."""
    digits = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(digits != "", F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def scaled_ring(ring: Column, x: float, y: float) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] * x).alias("x"), (p["y"] * y).alias("y")))


def flipped_ring(ring: Column, height: Column) -> Column:
    """From image rows, counted downwards, to heights above the lowest row, cut to the image."""
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), F.greatest(F.lit(0.0), F.least(height, height - p["y"])).alias("y")))


def covered(runs: DataFrame, others: DataFrame) -> DataFrame:
    """(ex, id, inside, outside): pixels of each object that objects of ``others`` cover, each once, and those that none covers."""
    met = r.met(runs, others).select("ex", "id", "row", "lo", "hi")
    before = F.max("hi").over(Window.partitionBy("ex", "id", "row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    fresh = met.withColumn("_to", before).select("ex", "id", F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce("_to", F.col("lo") - 1))).alias("k"))
    inside = fresh.groupBy("ex", "id").agg(F.sum("k").alias("inside"))
    return r.sizes(runs).join(inside, ["ex", "id"], "left").select("ex", "id", F.coalesce("inside", F.lit(0)).alias("inside"), (F.col("n") - F.coalesce("inside", F.lit(0))).alias("outside"))


def correlations_by_group(df: DataFrame, group: str, subject: str, region: str, value: str, least: int = 4) -> DataFrame:
    """(group, region_a, region_b, r, n) over subjects with a value in both regions, region_a < region_b, at least ``least`` of them.

    Values of a subject and region are averaged first. NULL keys and values take no part; a constant side has a NULL r.
    """
    means = df.dropna(subset=[group, subject, region, value]).groupBy(group, subject, region).agg(F.avg(value).alias("_v"))
    a, b = means.withColumnsRenamed({region: "region_a", "_v": "_a"}), means.withColumnsRenamed({region: "region_b", "_v": "_b"})
    pairs = a.join(b, [group, subject]).where("region_a < region_b")
    flat = (F.min("_a") == F.max("_a")) | (F.min("_b") == F.max("_b"))
    return pairs.groupBy(group, "region_a", "region_b").agg(F.when(~flat, F.corr("_a", "_b")).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def neighbourhood_run(links: DataFrame, values: DataFrame, id_col: str, features: list[str], radii: list[float]) -> DataFrame:
    """(radius, feature, id, n, delta) for links (id, neighbour, distance) within the largest radius: one plan for all radii and features."""
    each = F.explode(F.filter(F.array(*[F.lit(float(x)) for x in radii]), lambda x: x >= F.col("distance")))
    wide = values.select(F.col(id_col).alias("id"), F.create_map(*[v for f in features for v in (F.lit(f), F.col(f))]).alias("_v"))
    met = links.select("id", "neighbour", each.alias("radius")).join(wide.withColumnsRenamed({"id": "neighbour"}), "neighbour")
    long = met.select("id", "radius", F.explode("_v").alias("feature", "value")).where("value IS NOT NULL")
    stats = long.groupBy("radius", "feature", "id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    own = wide.select("id", F.explode("_v").alias("feature", "own"))
    return stats.join(own, ["id", "feature"]).select("radius", "feature", "id", "n", (F.col("mean") - F.col("own")).alias("delta"))
