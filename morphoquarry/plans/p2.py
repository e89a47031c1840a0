"""Problem 2: scaling, area and centroid in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators.unify import CommonUnits
from morphoquarry.sources.tables import table


def _whole(c):
    return F.round(c).cast("long")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    units = CommonUnits(table(spark, folder, "rpdf"), table(spark, folder, "exmd"))
    text = F.lit(None).cast("string")
    scaling = (
        units.examples.select("ex_i", F.explode(F.array(*[F.struct(F.lit(a.upper()).alias("axis"), F.col(f"{a}_pm").alias("v")) for a in "xyz"])).alias("s"))
        .where("s.v IS NOT NULL AND ex_i IS NOT NULL")
        .select(F.lit("scaling").alias("field"), "ex_i", F.lit(0).cast("long").alias("obj_id"), "s.axis", _whole(F.col("s.v")).alias("value"))
        .distinct()
    )
    c = F.col("centroid")
    size = F.size(c)
    area = F.array(F.struct(F.lit("area").alias("field"), F.col("spatial_axes").alias("axis"), F.col("area").alias("v")))
    names = F.when(size == 3, F.array(F.lit("Z"), F.lit("Y"), F.lit("X"))).otherwise(F.array(F.lit("Y"), F.lit("X")))
    places = F.when(c.isNull(), F.array()).otherwise(F.zip_with(names, c, lambda a, v: F.struct(F.lit("centroid").alias("field"), a.alias("axis"), v.alias("v"))))
    objects = units.objects().where("area IS NOT NULL OR centroid IS NOT NULL")
    rows = objects.select("ex_i", "obj_id", F.explode(F.concat(area, places)).alias("s")).where("s.v IS NOT NULL")
    return scaling.unionAll(rows.select("s.field", "ex_i", F.col("obj_id").cast("long"), "s.axis", _whole(F.col("s.v")).alias("value")))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
