"""Round trips through files, staged runs and appended partials."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import aggregate as a
from morphoquarry.operators import geometry as g
from morphoquarry.plans.aggregates import AREA_SQL, POLY_SQL, polygons
from morphoquarry.plans.stages import Stage, run
from morphoquarry.session import work_dir
from morphoquarry.sources import files, sinks
from morphoquarry.sources.tables import OBJECTS_SQL, objects, table
from morphoquarry.streaming.partials import append_partials

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.replace("{OBJ}", OBJECTS_SQL).replace("{POLY}", POLY_SQL)
        return fn

    return add


def _folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/mq-files-{uuid.uuid4().hex}"


@query("SELECT obj_id, ex_i, label, area, intensity_mean FROM {OBJ}")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    rows = objects(spark, d).select("obj_id", "ex_i", "label", "area", "intensity_mean", "centroid")
    sinks.write_all({"all_rpdfs": rows}, folder)
    back = files.read_csv_tables(spark, folder, {"all_rpdfs": "obj_id long, ex_i string, label long, area double, intensity_mean double, centroid string"})
    return back["all_rpdfs"].drop("centroid")


@query(f"SELECT poly_id, round(ring_area - hole_area, 3) AS area FROM {AREA_SQL}")
def geojson_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_features(polygons(spark, d), folder, properties=["poly_id"])
    back = files.read_features(spark, folder)
    area = g.polygon_area(F.col("ring"), F.col("holes"))
    return back.select(F.get_json_object("properties", "$.poly_id").cast("long").alias("poly_id"), F.round(area, 3).alias("area"))


@query("SELECT ex_i, colocal_id, count(*) AS n FROM (SELECT DISTINCT * FROM rpdf) GROUP BY ALL".replace("(SELECT DISTINCT * FROM rpdf)", "rpdf"))
def appended_partials(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    rows = table(spark, d, "rpdf").select("ex_i", "colocal_id")
    rows.write.parquet(f"{folder}/in")
    append_partials(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/state", lambda b: b.groupBy("ex_i", "colocal_id").agg(F.count(F.lit(1)).alias("n")))
    return spark.read.parquet(f"{folder}/out").groupBy("ex_i", "colocal_id").agg(F.sum("n").alias("n"))


@query("""SELECT treatment, colocal_id, count(*) AS n, round(avg(intensity_mean), 6) AS intensity_mean FROM {OBJ} JOIN exmd USING (ex_i) WHERE area > 5 AND treatment IS NOT NULL GROUP BY ALL""")
def staged_summary(spark: SparkSession, d: str) -> DataFrame:
    """Detection, then enrichment by examples, then a compiled summary, in one plan over all examples."""
    detect = Stage("object_detection", lambda t: {"rpdf": t["rpdf"].where("area > 5")}, lambda t: {"summary": a.summarise(t["rpdf"], ["treatment", "colocal_id"], ["intensity_mean"], "n")}, needs=("rpdf",))
    enrich = Stage("examples", lambda t: {"rpdf": t["rpdf"].join(t["exmd"].select("ex_i", "treatment"), "ex_i")}, needs=("exmd",), after=("object_detection",))
    _, results = run([enrich, detect], {"rpdf": objects(spark, d), "exmd": table(spark, d, "exmd")})
    return results["summary"].withColumn("intensity_mean", F.round("intensity_mean", 6))
