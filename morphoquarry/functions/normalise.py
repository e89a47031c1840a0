"""Number ranges within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphoquarry.operators.twostage import with_percentiles, with_statistics


def min_max(df: DataFrame, value: str, keys: list[str], out: str, clip: tuple[float, float] | None = None) -> DataFrame:
    """Adds the value scaled to 0…1 within the group; 0 where all values are equal."""
    v = F.greatest(F.least(F.col(value), F.lit(clip[1])), F.lit(clip[0])) if clip else F.col(value)
    rows = with_statistics(df.withColumn("_v", F.when(F.col(value).isNotNull(), v)), keys, {"_lo": F.min("_v"), "_hi": F.max("_v")})
    scaled = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return rows.withColumn(out, F.when(F.col("_v").isNotNull(), scaled)).drop("_v", "_lo", "_hi")


def percentile_norm(df: DataFrame, value: str, keys: list[str], out: str, low: float = 0.01, high: float = 0.998, clip: bool = True) -> DataFrame:
    """Adds the value scaled to 0…1 between two interpolated percentiles of the group, cut at the ends on request."""
    rows = with_percentiles(df, keys, value, [low, high], "_q")
    a, b = F.col("_q")[0], F.col("_q")[1]
    scaled = F.coalesce(F.try_divide(F.col(value) - a, b - a), F.lit(0.0))
    ended = F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)) if clip else scaled
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), ended)).drop("_q")


def to_bits(share: Column, bits: int) -> Column:
    """A share of 0…1 as a whole number of so many bits."""
    return F.rint(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * (2**bits - 1)).cast("int")


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Luminance of linear colour channels."""
    return red * 0.2125 + green * 0.7154 + blue * 0.0721


def match_mean(df: DataFrame, value: str, keys: list[str], target: float, out: str) -> DataFrame:
    """Adds the value times what brings the group's mean to the target; unchanged where the mean is 0."""
    rows = with_statistics(df, keys, {"_m": F.avg(value)})
    return rows.withColumn(out, F.col(value) * F.coalesce(F.try_divide(F.lit(target), F.col("_m")), F.lit(1.0))).drop("_m")
