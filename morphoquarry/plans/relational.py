"""Filters, joins, set operations and reshaping on the object table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import filters as f
from morphoquarry.operators import sets as s
from morphoquarry.operators.reshape import melt, pivot_by_id
from morphoquarry.sources.tables import OBJECTS_SQL, objects, table

RANGES = {"area": (10.0, 5000.0), "intensity_mean": (200.0, 2000.0)}
THRESHOLDS = {"area": [5, 5000], "intensity_mean": [200, 2000], "0": {"area": [20, 400]}, "1": {"intensity_mean": [300, None]}}
SPECS = {3: [1, 2], 4: [0, 1, 2]}
IDS = [0, 1, 2, 3, 4]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.replace("{OBJ}", OBJECTS_SQL)
        return fn

    return add


KEEP = ["obj_id", "ex_i", "colocal_id", "label", "area", "intensity_mean"]
KEEP_SQL = ", ".join(KEEP)
PASS_SQL = """((colocal_id = 0 AND area > 20 AND area < 400 AND intensity_mean > 200 AND intensity_mean < 2000) OR (colocal_id = 1 AND area > 5 AND area < 5000 AND intensity_mean > 300)
  OR (colocal_id IN (2, 3, 4) AND area > 5 AND area < 5000 AND intensity_mean > 200 AND intensity_mean < 2000))"""


@query(f"SELECT {KEEP_SQL} FROM {{OBJ}} WHERE area > 10 AND area < 5000 AND intensity_mean > 200 AND intensity_mean < 2000")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d, f.all_in_range(RANGES)).select(*KEEP)


@query("""SELECT colocal_id, count(*) AS pre_filters, count(*) FILTER (area > 10 AND area < 5000) AS post_area,
count(*) FILTER (area > 10 AND area < 5000 AND intensity_mean > 200 AND intensity_mean < 2000) AS post_intensity_mean FROM {OBJ} GROUP BY colocal_id""")
def threshold_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return f.range_counts(objects(spark, d), RANGES, ["colocal_id"])


@query(f"SELECT {KEEP_SQL} FROM {{OBJ}} WHERE {PASS_SQL}")
def threshold_per_id(spark: SparkSession, d: str) -> DataFrame:
    return f.thresholds_by_id(objects(spark, d), "colocal_id", f.spread_thresholds(THRESHOLDS, IDS)).select(*KEEP)


@query(f"""WITH p AS (SELECT * FROM {{OBJ}} WHERE {PASS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY ex_i, colocal_id, ch1_intersecting_label ORDER BY intersection_percent DESC NULLS LAST, label) AS k FROM p WHERE colocal_id IN (3, 4) AND ch1_intersecting_label IS NOT NULL),
c AS (SELECT ex_i, colocal_id, label, obj_id FROM r WHERE k = 1 UNION ALL SELECT ex_i, colocal_id, label, obj_id FROM p WHERE colocal_id IN (3, 4) AND ch1_intersecting_label IS NULL)
SELECT obj_id, ex_i, colocal_id, label FROM p WHERE colocal_id IN (0, 1, 2)
UNION ALL SELECT obj_id, ex_i, colocal_id, label FROM c WHERE EXISTS (SELECT 1 FROM p WHERE p.colocal_id = 2 AND p.ex_i = c.ex_i AND p.label = c.label)""")
def filter_objects(spark: SparkSession, d: str) -> DataFrame:
    rows = f.filter_objects(objects(spark, d), f.spread_thresholds(THRESHOLDS, IDS), SPECS, ["ex_i"], "colocal_id", "label", "ch1_intersecting_label", "intersection_percent")
    return rows.select("obj_id", "ex_i", "colocal_id", "label")


@query("""SELECT obj_id, ex_i, colocal_id, label, ch1_intersecting_label, intersection_percent FROM (
SELECT *, row_number() OVER (PARTITION BY ex_i, colocal_id, ch1_intersecting_label ORDER BY intersection_percent DESC NULLS LAST, label) AS k FROM {OBJ} WHERE ch1_intersecting_label IS NOT NULL) WHERE k = 1""")
def dedupe_top1(spark: SparkSession, d: str) -> DataFrame:
    rows = objects(spark, d, "ch1_intersecting_label IS NOT NULL")
    return f.best_match_only(rows, ["ex_i", "colocal_id"], "ch1_intersecting_label", "intersection_percent", "label").select("obj_id", "ex_i", "colocal_id", "label", "ch1_intersecting_label", "intersection_percent")


@query("SELECT obj_id, ex_i, label FROM {OBJ} c WHERE colocal_id = 3 AND EXISTS (SELECT 1 FROM {OBJ} p WHERE p.colocal_id = 2 AND p.ex_i = c.ex_i AND p.label = c.label)")
def semi_join_parents(spark: SparkSession, d: str) -> DataFrame:
    return f.surviving_children(objects(spark, d, "colocal_id = 3"), objects(spark, d, "colocal_id = 2"), ["ex_i", "label"]).select("obj_id", "ex_i", "label")


@query(f"SELECT DISTINCT ex_i, colocal_id, label FROM {{OBJ}} o WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM {{OBJ}} WHERE {PASS_SQL}) p WHERE p.obj_id = o.obj_id)")
def invalid_labels_except(spark: SparkSession, d: str) -> DataFrame:
    rows, key = objects(spark, d), ["ex_i", "colocal_id", "label"]
    valid = f.thresholds_by_id(rows, "colocal_id", f.spread_thresholds(THRESHOLDS, IDS))
    return rows.select(*key).subtract(valid.select(*key))


@query("SELECT i AS colocal_id, (SELECT count(*) FROM {OBJ} o WHERE o.colocal_id = i) AS n FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) t(i)")
def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    return f.zero_filled_counts(objects(spark, d), "colocal_id", [*IDS, 5, 6])


@query("SELECT obj_id FROM {OBJ} WHERE ex_i = 'ex1' AND colocal_id = 1")
def query_equality(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d, f.equals(ex_i="ex1", colocal_id=1)).select("obj_id")


@query("SELECT obj_id, ex_i, label, area FROM (SELECT *, row_number() OVER (PARTITION BY ex_i, colocal_id ORDER BY area DESC NULLS LAST, obj_id) AS k FROM {OBJ}) WHERE k <= 3")
def largest_objects(spark: SparkSession, d: str) -> DataFrame:
    return f.top_per_key(objects(spark, d), ["ex_i", "colocal_id"], [F.col("area").desc_nulls_last(), F.col("obj_id")], 3).select("obj_id", "ex_i", "label", "area")


@query("SELECT obj_id, ex_i, area FROM {OBJ} WHERE area BETWEEN 10 AND 500")
def size_filter_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d, f.all_in_range({"area": (10.0, 500.0)}, inclusive=True)).select("obj_id", "ex_i", "area")


@query("""SELECT obj_id, CASE WHEN label BETWEEN 5 AND 9 THEN -2 WHEN label = 3 THEN -1 ELSE label END AS mapped FROM {OBJ}""")
def range_map(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).select("obj_id", f.map_ranges(F.col("label"), {3: -1, (5, 9): -2}).alias("mapped"))


@query("""SELECT obj_id, ex_i, label FROM {OBJ} WHERE centroid IS NOT NULL AND len(list_filter(centroid, lambda v: v IS NULL OR isnan(v))) = 0
AND centroid[len(centroid)] BETWEEN 10 AND 200 AND centroid[len(centroid) - 1] BETWEEN 20 AND 150""")
def coordinate_box_filter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("centroid")
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    return objects(spark, d, c.isNotNull() & whole & F.element_at(c, -1).between(10, 200) & F.element_at(c, -2).between(20, 150)).select("obj_id", "ex_i", "label")


@query("""WITH m AS (SELECT *, median(intensity_mean) OVER (PARTITION BY colocal_id) AS med FROM {OBJ} WHERE intensity_mean IS NOT NULL),
a AS (SELECT *, median(abs(intensity_mean - med)) OVER (PARTITION BY colocal_id) AS mad FROM m)
SELECT obj_id, colocal_id, intensity_mean FROM a WHERE mad > 0 AND abs(intensity_mean - med) * 0.6745 / mad > 2.241402727604945""")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    return f.mad_outliers(objects(spark, d), "intensity_mean", ["colocal_id"]).select("obj_id", "colocal_id", "intensity_mean")


@query("""WITH spec(colocal_id, inherited_id) AS (VALUES (3, 2), (4, 2), (4, 3)), o AS (SELECT * FROM {OBJ})
SELECT obj_id, ex_i, colocal_id, label FROM o WHERE NOT EXISTS (SELECT 1 FROM o c JOIN spec ON spec.colocal_id = c.colocal_id WHERE spec.inherited_id = o.colocal_id AND c.ex_i = o.ex_i AND c.label = o.label)""")
def separate_populations(spark: SparkSession, d: str) -> DataFrame:
    return s.separate_populations(objects(spark, d), SPECS, ["ex_i"], "colocal_id", "label").select("obj_id", "ex_i", "colocal_id", "label")


@query("""WITH base(colocal_id, base_id) AS (VALUES (3, 2), (4, 2)), o AS (SELECT * FROM {OBJ})
SELECT obj_id, ex_i, o.colocal_id, label FROM o JOIN base USING (colocal_id) WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.colocal_id = base.base_id AND b.ex_i = o.ex_i AND b.label = o.label)""")
def unmatched_composites(spark: SparkSession, d: str) -> DataFrame:
    return s.unmatched_composites(objects(spark, d), SPECS, ["ex_i"], "colocal_id", "label").select("obj_id", "ex_i", "colocal_id", "label")


@query("""SELECT 'base' AS kind, obj_id, intensity_mean, NULL AS intersection_percent FROM {OBJ} WHERE colocal_id < 3
UNION ALL SELECT 'composite', obj_id, NULL, intersection_percent FROM {OBJ} WHERE colocal_id >= 3""")
def union_padded(spark: SparkSession, d: str) -> DataFrame:
    base = objects(spark, d, "colocal_id < 3").select(F.lit("base").alias("kind"), "obj_id", "intensity_mean")
    return s.padded_union(base, objects(spark, d, "colocal_id >= 3").select(F.lit("composite").alias("kind"), "obj_id", "intersection_percent"))


@query("SELECT obj_id, unnest(CASE WHEN colocal_id = 2 THEN [2, 3, 4] ELSE [colocal_id] END) AS colocal_id, label FROM {OBJ}")
def roi_rows_replicated(spark: SparkSession, d: str) -> DataFrame:
    return s.replicate_rows(objects(spark, d).select("obj_id", "colocal_id", "label"), "colocal_id", {2: [3, 4]})


@query("SELECT DISTINCT treatment, genotype, sex FROM exmd")
def distinct_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exmd").select("treatment", "genotype", "sex").distinct()


@query("SELECT obj_id, epoch_us(max(loaded_at)) AS loaded_us FROM rpdf GROUP BY obj_id")
def keep_last_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return s.keep_last(table(spark, d, "rpdf"), ["obj_id"], [F.col("loaded_at").desc_nulls_last()]).select("obj_id", F.unix_micros("loaded_at").alias("loaded_us"))


@query("SELECT obj_id, count(*) AS n FROM rpdf GROUP BY obj_id HAVING count(*) > 1")
def duplicate_check(spark: SparkSession, d: str) -> DataFrame:
    return s.duplicate_keys(table(spark, d, "rpdf"), ["obj_id"])


@query("""WITH o AS (SELECT obj_id, ex_i, colocal_id, label FROM {OBJ}), n AS (SELECT obj_id, ex_i, colocal_id, label + 1000 AS label FROM o WHERE colocal_id = 1 AND label < 4)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ex_i = o.ex_i AND n.colocal_id = o.colocal_id) UNION ALL SELECT * FROM n""")
def annotation_override(spark: SparkSession, d: str) -> DataFrame:
    rows = objects(spark, d).select("obj_id", "ex_i", "colocal_id", "label")
    newer = rows.where("colocal_id = 1 AND label < 4").withColumn("label", F.col("label") + 1000)
    return s.replace_partitions(rows, newer, ["ex_i", "colocal_id"])


@query("""SELECT a.obj_id, a.ex_i, a.intensity_mean, b.intensity_1 FROM {OBJ} a JOIN (SELECT ex_i, roi_i, avg(intensity_mean) AS intensity_1 FROM {OBJ} WHERE colocal_id = 1 GROUP BY ex_i, roi_i) b
ON a.ex_i = b.ex_i AND a.roi_i = b.roi_i""".replace("b.intensity_1 FROM", "round(b.intensity_1, 6) AS intensity_1 FROM", 1))
def intensity_self_join(spark: SparkSession, d: str) -> DataFrame:
    rows = objects(spark, d)
    one = objects(spark, d, "colocal_id = 1").groupBy("ex_i", "roi_i").agg(F.avg("intensity_mean").alias("intensity_1"))
    return rows.join(one, ["ex_i", "roi_i"]).select("obj_id", "ex_i", "intensity_mean", F.round("intensity_1", 6).alias("intensity_1"))


@query("""SELECT coalesce(a.ex_i, b.ex_i) AS ex_i, coalesce(a.label, b.label) AS label, a.v AS intensity_0, b.v AS intensity_1
FROM (SELECT ex_i, label, max(intensity_mean) AS v FROM {OBJ} WHERE colocal_id = 0 GROUP BY ex_i, label) a FULL JOIN (SELECT ex_i, label, max(intensity_mean) AS v FROM {OBJ} WHERE colocal_id = 1 GROUP BY ex_i, label) b ON a.ex_i = b.ex_i AND a.label = b.label""")
def object_intensities_outer(spark: SparkSession, d: str) -> DataFrame:
    one = lambda i: objects(spark, d, F.col("colocal_id") == i).groupBy("ex_i", "label").agg(F.max("intensity_mean").alias(f"intensity_{i}"))
    return one(0).join(one(1), ["ex_i", "label"], "full_outer").select("ex_i", "label", "intensity_0", "intensity_1")


@query("""SELECT ex_i, label, max(intensity_mean) FILTER (colocal_id = 0) AS intensity_mean_ch0, max(intensity_mean) FILTER (colocal_id = 1) AS intensity_mean_ch1, max(intensity_mean) FILTER (colocal_id = 2) AS intensity_mean_ch2
FROM {OBJ} WHERE colocal_id < 3 GROUP BY ex_i, label HAVING count(*) FILTER (colocal_id = 0) > 0""")
def pivot_channel_intensities(spark: SparkSession, d: str) -> DataFrame:
    return pivot_by_id(objects(spark, d), ["ex_i", "label"], "colocal_id", [0, 1, 2], ["intensity_mean"])


@query("""SELECT obj_id, feature, value FROM (SELECT obj_id, axis_major_length, axis_minor_length, eccentricity FROM {OBJ}) UNPIVOT INCLUDE NULLS (value FOR feature IN (axis_major_length, axis_minor_length, eccentricity))""")
def unpivot_features(spark: SparkSession, d: str) -> DataFrame:
    return melt(objects(spark, d), ["obj_id"], ["axis_major_length", "axis_minor_length", "eccentricity"], "feature", "value")


@query("""SELECT treatment, round(avg(intensity_mean) FILTER (colocal_id = 0), 6) AS c0, round(avg(intensity_mean) FILTER (colocal_id = 1), 6) AS c1, round(avg(intensity_mean) FILTER (colocal_id = 2), 6) AS c2
FROM {OBJ} JOIN exmd USING (ex_i) GROUP BY treatment""")
def pivot_table_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = objects(spark, d).join(table(spark, d, "exmd").select("ex_i", "treatment"), "ex_i")
    wide = rows.groupBy("treatment").pivot("colocal_id", [0, 1, 2]).agg(F.avg("intensity_mean"))
    return wide.select("treatment", *[F.round(str(i), 6).alias(f"c{i}") for i in range(3)])


@query("SELECT regexp_extract(name, '^(\\S+)', 1) AS first_word, count(*) AS n FROM (SELECT DISTINCT id, name FROM ontology) GROUP BY 1")
def regex_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ontology").select("id", "name").distinct()
    return rows.groupBy(F.regexp_extract("name", r"^(\S+)", 1).alias("first_word")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT obj_id, concat_ws('###', ex_i, CAST(label AS VARCHAR)) AS object_key, substr(split_part(dend_id, '_', 1), 3) AS dend_example FROM {OBJ}")
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).select("obj_id", F.concat_ws("###", "ex_i", F.col("label").cast("string")).alias("object_key"), F.expr("substr(split_part(dend_id, '_', 1), 3)").alias("dend_example"))


@query("""SELECT scene_name, p.name AS pattern FROM (SELECT DISTINCT scene_name FROM exmd WHERE scene_name IS NOT NULL) s
LEFT JOIN LATERAL (SELECT name FROM (VALUES (1, 'scene'), (2, 'S'), (3, '1')) v(i, name) WHERE contains(lower(s.scene_name), lower(name)) ORDER BY i LIMIT 1) p ON true""")
def contains_match(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "exmd").select("scene_name").where("scene_name IS NOT NULL").distinct()
    patterns = ["scene", "S", "1"]
    first = F.coalesce(*[F.when(F.contains(F.lower("scene_name"), F.lit(p.lower())), F.lit(p)) for p in patterns])
    return names.select("scene_name", first.alias("pattern"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
