"""Problem 3: results per dendrite and per animal although a few ids hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators.salted import Measure, merge, partials, salted_aggregate
from morphoquarry.sources.tables import table

#: Percent of all rows beyond which a key counts as heavy.
PERCENT = 3


def _per_key(spark: SparkSession, folder: str, measures: list[Measure], columns: list[str]) -> tuple[DataFrame, int]:
    """Rows (id_col, key_value, n_rows, measures…) for both ids. Examples are aggregated before they meet their animals."""
    raw = table(spark, folder, "rpdf")
    rows = raw.count()
    dend = salted_aggregate(raw.select("dend_id", *columns), "dend_id", measures, rows)
    animals = table(spark, folder, "exmd").select("ex_i", "animal_number").where("animal_number IS NOT NULL").distinct()
    by_example = partials(raw.select("ex_i", *columns).where("ex_i IS NOT NULL"), "ex_i", measures, rows)
    animal = merge(by_example.join(animals, "ex_i"), ["animal_number"], measures)
    parts = [d.select(F.lit(c).alias("id_col"), F.col(c).alias("key_value"), *[x for x in d.columns if x != c]) for c, d in (("dend_id", dend), ("animal_number", animal))]
    return parts[0].unionByName(parts[1]), rows


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    keys, rows = _per_key(spark, folder, [], [])
    return keys.where(F.col("n_rows") * 100 > PERCENT * rows).select("id_col", "key_value")


def p3_key_stats(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("intensity_mean")
    measures = [Measure("n_intensity", "count", F.when(~F.isnan(v), v)), Measure("mean_intensity", "avg", v), Measure("sd_intensity", "std", v), Measure("max_area", "max", F.col("area"))]
    return _per_key(spark, folder, measures, ["intensity_mean", "area"])[0].select("id_col", "key_value", "n_rows", "n_intensity", F.round("mean_intensity", 6).alias("mean_intensity"), F.round("sd_intensity", 4).alias("sd_intensity"), "max_area")


_UNION = """FROM (SELECT 'dend_id' AS id_col, dend_id AS key_value, intensity_mean AS v, area FROM rpdf WHERE dend_id IS NOT NULL
  UNION ALL SELECT 'animal_number', animal_number, intensity_mean, area FROM rpdf JOIN (SELECT DISTINCT ex_i, animal_number FROM exmd) e USING (ex_i) WHERE animal_number IS NOT NULL)
GROUP BY id_col, key_value"""
QUERIES = {"p3_found": p3_found, "p3_key_stats": p3_key_stats}
SQL = {
    "p3_found": f"SELECT id_col, key_value {_UNION} HAVING count(*) * 100 > 3 * (SELECT count(*) FROM rpdf)",
    "p3_key_stats": f"""SELECT id_col, key_value, count(*) AS n_rows, count(v) FILTER (NOT isnan(v)) AS n_intensity, round(avg(v) FILTER (NOT isnan(v)), 6) AS mean_intensity,
  round(stddev_samp(v) FILTER (NOT isnan(v)), 4) AS sd_intensity, max(area) FILTER (NOT isnan(area)) AS max_area {_UNION}""",
}
