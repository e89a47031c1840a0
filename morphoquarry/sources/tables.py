"""Table access by folder: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def objects(spark: SparkSession, folder: str, where=None) -> DataFrame:
    """The object table, each object once and NaN as NULL; repeated rows differ in their load time alone.

    ``where`` keeps rows before repeats are removed, so that the condition reaches the Parquet scan; it meets NaN as such.
    """
    from pyspark.sql import functions as F

    df = table(spark, folder, "rpdf").drop("loaded_at")
    if where is not None:
        df = df.where(where)
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, kind in df.dtypes if kind == "double"}).dropDuplicates(["obj_id"])


#: The same in SQL.
OBJECTS_SQL = """(SELECT DISTINCT obj_id, ex_i, colocal_id, label, dend_id, roi_i, CASE WHEN isnan(area) THEN NULL ELSE area END AS area, area_unit, centroid, centroid_unit,
  CASE WHEN isnan(intensity_mean) THEN NULL ELSE intensity_mean END AS intensity_mean, intensity_max, axis_major_length, axis_minor_length, eccentricity, ch1_intersecting_label,
  CASE WHEN isnan(intersection_percent) THEN NULL ELSE intersection_percent END AS intersection_percent, quantified_at FROM rpdf)"""
