"""Property tables, summaries, roll-ups along trees and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_keys(df: DataFrame, keys: list[str]) -> list[str]:
    """Keys that the table has and that hold a value somewhere; one pass counts them."""
    have = [k for k in keys if k in df.columns]
    counts = df.agg(*[F.count(F.col(k)).alias(k) for k in have]).first() if have else {}
    return [k for k in have if counts[k]]


def summarise(df: DataFrame, keys: list[str], means: list[str], count: str = "count") -> DataFrame:
    """Rows and means per group in one aggregation; rows with a NULL key belong to no group."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *[F.avg(m).alias(m) for m in means])


def density(df: DataFrame, regions: DataFrame, keys: list[str], area: str, count: str = "count", out: str = "count_per_area") -> DataFrame:
    """Adds a region's columns and the count over its area; NULL without a region or where the area is 0."""
    return df.join(regions, keys, "left").withColumn(out, F.try_divide(F.col(count), F.col(area)))


def weighted_means(df: DataFrame, keys: list[str], sums: list[str], means: list[str], weight: str = "count") -> DataFrame:
    """Sums, and means weighted by a count; a NULL mean has no weight."""
    averages = [F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m) for m in means]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *averages)


def roll_up(objects: DataFrame, closure: DataFrame, region: str, population: list[str], means: list[str]) -> DataFrame:
    """Each object counts for its region and every ancestor; regions without objects have count 0 and NULL means for every population.

    Objects are summed per region first, so the closure meets one row per population and region, not every object.
    """
    parts = objects.where(F.col(region).isNotNull()).groupBy(*population, region).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"s_{m}") for m in means], *[F.count(m).alias(f"c_{m}") for m in means])
    up = parts.join(closure.select(F.col("descendant").alias(region), "ancestor"), region)
    sums = up.groupBy(*population, F.col("ancestor").alias(region)).agg(F.sum("n").alias("n"), *[F.try_divide(F.sum(f"s_{m}"), F.sum(f"c_{m}")).alias(m) for m in means])
    scaffold = _scaffold(objects, closure, region, population)
    same = sums.withColumnsRenamed({p: f"_{p}" for p in [*population, region]})
    on = [scaffold[c].eqNullSafe(same[f"_{c}"]) for c in [*population, region]]
    return scaffold.join(same, on, "left").select(*population, region, F.coalesce("n", F.lit(0)).alias("count"), *means)


#: Populations that may be broadcast to complete a roll-up.
BROADCAST_POPULATIONS = 10_000


def _scaffold(objects: DataFrame, closure: DataFrame, region: str, population: list[str]) -> DataFrame:
    """Every population with every region, which are the rows of the result."""
    populations = objects.select(*population).distinct().withColumn("_mq", F.lit(1))
    few = populations.limit(BROADCAST_POPULATIONS + 1).count() <= BROADCAST_POPULATIONS
    regions = closure.select(F.col("ancestor").alias(region)).distinct().withColumn("_mq", F.lit(1))
    return regions.join(F.broadcast(populations) if few else populations, "_mq").drop("_mq")


def largest_group(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(keys, group): the group with most rows; ties go to the smallest; NULL groups don't count."""
    counts = df.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(group, F.struct(-F.col("n"), F.col(group))).alias(group))


def variation(value: Column) -> Column:
    """Coefficient of variation: sample deviation over mean, NULL if the mean is 0."""
    return F.try_divide(F.stddev_samp(value), F.avg(value))


def zscores_of_groups(df: DataFrame, group: list[str], features: list[str]) -> DataFrame:
    """Per group: rows, means and how far each mean lies from that of all rows, in deviations of all rows (NULL where that is 0)."""
    overall = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"d_{c}") for c in features]).first()
    groups = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in features])
    return groups.select(*group, "n", *features, *[F.try_divide(F.col(c) - F.lit(overall[f"m_{c}"]), F.lit(overall[f"d_{c}"])).alias(f"z_{c}") for c in features])


def region_properties(voxels: DataFrame, keys: list[str], axes: list[str], intensity: str | None = None, with_coords: bool = False) -> DataFrame:
    """Properties of labelled objects from their voxels, in one aggregation.

    area, centroid, half-open bbox (least…, greatest + 1…), intensity mean/min/max/std (population) and biased skewness
    and excess kurtosis; in two dimensions also the axis lengths of the ellipse with the same second moments (each voxel
    a unit square) and their ratio as eccentricity, NULL if the minor axis is 0. ``coords`` only on request: it holds all
    of an object's voxels.
    """
    out = [F.count(F.lit(1)).alias("area"), F.array(*[F.avg(a) for a in axes]).alias("centroid"), F.array(*[F.min(a).cast("long") for a in axes], *[(F.max(a) + 1).cast("long") for a in axes]).alias("bbox")]
    if intensity:
        v = F.col(intensity).cast("double")
        out += [F.avg(v).alias("intensity_mean"), F.min(v).alias("intensity_min"), F.max(v).alias("intensity_max"), F.stddev_pop(v).alias("intensity_std"), F.skewness(v).alias("skewedness"), F.kurtosis(v).alias("kurtosis")]
    if with_coords:
        out.append(F.sort_array(F.collect_list(F.array(*axes))).alias("coords"))
    if len(axes) == 2:
        a, b = axes
        out += [F.var_pop(a).alias("_aa"), F.var_pop(b).alias("_bb"), F.covar_pop(a, b).alias("_ab")]
    df = voxels.groupBy(*keys).agg(*out)
    if len(axes) == 2:
        aa, bb, ab = F.col("_aa") + 1 / 12, F.col("_bb") + 1 / 12, F.col("_ab")
        root = F.sqrt((aa - bb) * (aa - bb) / 4 + ab * ab)
        major = 4 * F.sqrt((aa + bb) / 2 + root)
        minor = 4 * F.sqrt(F.greatest((aa + bb) / 2 - root, F.lit(0.0)))
        df = df.withColumns({"axis_major_length": major, "axis_minor_length": minor}).withColumn("eccentricity", F.try_divide("axis_major_length", "axis_minor_length")).drop("_aa", "_bb", "_ab")
    return df


def best_overlaps(left: DataFrame, right: DataFrame, place: list[str], left_label: str, right_label: str) -> DataFrame:
    """(left, right, shared, iou) for each left object and the right one that shares most voxels with it; ties go to the smaller label."""
    scope, axes = place[:1], place
    a, b = left.select(*axes, F.col(left_label).alias("_l")), right.select(*axes, F.col(right_label).alias("_r"))
    shared = a.join(b, axes).groupBy(*scope, "_l", "_r").agg(F.count(F.lit(1)).alias("shared"))
    sizes_l = a.groupBy(*scope, "_l").agg(F.count(F.lit(1)).alias("_nl"))
    sizes_r = b.groupBy(*scope, "_r").agg(F.count(F.lit(1)).alias("_nr"))
    best = shared.groupBy(*scope, "_l").agg(F.min_by(F.struct("_r", "shared"), F.struct(-F.col("shared"), F.col("_r"))).alias("s")).select(*scope, "_l", "s.*")
    full = best.join(sizes_l, [*scope, "_l"]).join(sizes_r, [*scope, "_r"])
    return full.select(*scope, F.col("_l").alias(left_label), F.col("_r").alias(right_label), "shared", (F.col("shared") / (F.col("_nl") + F.col("_nr") - F.col("shared"))).alias("iou"))
