"""Small joins, columns and composite runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import filters as f
from morphoquarry.operators import learn as l
from morphoquarry.operators import relate as o
from morphoquarry.operators import stats as s
from morphoquarry.operators.neighbours import both_ways
from morphoquarry.operators.proximity import near_pairs
from morphoquarry.operators.twostage import percentiles
from morphoquarry.plans.aggregates import POLY_SQL, polygons
from morphoquarry.plans.pixels import _runs, _sql
from morphoquarry.plans.relational import IDS, PASS_SQL, THRESHOLDS
from morphoquarry.plans.spatial import NEIGHBOUR_SQL, _placed
from morphoquarry.plans.stats import FEATURES, LONG_SQL, SYN_SQL, _long, _synapses
from morphoquarry.sources.tables import OBJECTS_SQL, objects, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = _sql(sql.replace("{OBJ}", OBJECTS_SQL).replace("{POLY}", POLY_SQL).replace("{LONG}", LONG_SQL).replace("{SYN}", SYN_SQL).replace("{NBR}", NEIGHBOUR_SQL))
        return fn

    return add


@query(f"SELECT obj_id, ex_i, colocal_id, CASE WHEN {PASS_SQL} THEN label ELSE 0 END AS label FROM {{OBJ}} WHERE ex_i IS NOT NULL")
def labels_kept(spark: SparkSession, d: str) -> DataFrame:
    """Labels of objects within their thresholds, 0 for the others."""
    rows = objects(spark, d).where("ex_i IS NOT NULL")
    kept = f.thresholds_by_id(rows, "colocal_id", f.spread_thresholds(THRESHOLDS, IDS))
    return o.keep_labels(rows.select("obj_id", "ex_i", "colocal_id", "label"), ["ex_i", "colocal_id"], "label", kept)


@query("""WITH p AS (SELECT ex_i, coalesce(channel, -1) AS c, unnest(ring) AS v FROM {POLY} WHERE ring IS NOT NULL AND ex_i IS NOT NULL), w AS (SELECT ex_i, c, CAST(round_even(v.x / 4, 0) AS BIGINT) AS x, CAST(round_even(v.y / 4, 0) AS BIGINT) AS y FROM p WHERE v.x IS NOT NULL AND v.y IS NOT NULL)
SELECT DISTINCT ex_i, x, y FROM w WHERE c = 0 AND NOT EXISTS (SELECT 1 FROM w q WHERE q.c = 1 AND q.ex_i = w.ex_i AND q.x = w.x AND q.y = w.y)""")
def places_of_one_channel(spark: SparkSession, d: str) -> DataFrame:
    """Cells of four pixels with a vertex of channel 0 and none of channel 1."""
    v = polygons(spark, d).where("ex_i IS NOT NULL").select("ex_i", "channel", F.explode("ring").alias("v")).where("v.x IS NOT NULL AND v.y IS NOT NULL")
    at = v.select("ex_i", "channel", *[F.rint(F.col(f"v.{a}") / 4).cast("long").alias(a) for a in "xy"])
    return o.without_places(at.where("channel = 0"), at.where("channel = 1"), ["ex_i", "x", "y"]).select("ex_i", "x", "y").distinct()


@query("""WITH a AS (SELECT variable, treatment, count(*) AS n, avg(value) AS mean FROM {LONG} WHERE genotype = 'KO' AND treatment IS NOT NULL GROUP BY ALL HAVING avg(value) > 1), b AS (SELECT variable, treatment, count(*) AS n, median(value) AS mid FROM {LONG} WHERE genotype = 'WT' AND treatment IS NOT NULL GROUP BY ALL HAVING median(value) < 100)
SELECT variable, treatment, a.n AS n_left, b.n AS n_right, round(mean, 6) AS mean, round(mid, 6) AS mid FROM a FULL JOIN b USING (variable, treatment)""")
def merged_test_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _long(spark, d).where("treatment IS NOT NULL")
    a = rows.where("genotype = 'KO'").groupBy("variable", "treatment").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).where("mean > 1")
    wt = rows.where("genotype = 'WT'")
    mid = percentiles(wt, ["variable", "treatment"], "value", [0.5], "q").select("variable", "treatment", F.col("q")[0].alias("mid"))
    b = wt.groupBy("variable", "treatment").agg(F.count(F.lit(1)).alias("n")).join(mid, ["variable", "treatment"]).where("mid < 100")
    return o.merge_results(a, b, ["variable", "treatment"]).withColumns({"mean": F.round("mean", 6), "mid": F.round("mid", 6)})


@query("""SELECT c.obj_id, c.ch1_intersecting_label, b.area AS clc1_area, b.intensity_mean AS clc1_intensity_mean FROM {OBJ} c LEFT JOIN (SELECT ex_i, label, area, intensity_mean FROM {OBJ} WHERE colocal_id = 1) b ON b.ex_i = c.ex_i AND b.label = c.ch1_intersecting_label WHERE c.colocal_id = 3""")
def partner_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = objects(spark, d)
    out = o.with_partner_properties(rows.where("colocal_id = 3"), rows.where("colocal_id = 1"), ["ex_i"], "label", "ch1_intersecting_label", ["area", "intensity_mean"], "clc1_")
    return out.select("obj_id", "ch1_intersecting_label", "clc1_area", "clc1_intensity_mean")


@query("""WITH r AS (SELECT ex_i, coalesce(roi_i, 0) AS roi_i, colocal_id, intensity_mean FROM {OBJ} WHERE ex_i IS NOT NULL AND colocal_id IS NOT NULL), m AS (SELECT ex_i, roi_i, colocal_id, avg(intensity_mean) AS v, count(intensity_mean) AS n FROM r GROUP BY ALL)
SELECT ex_i, roi_i, colocal_id, round(coalesce(v, 0), 6) AS intensity_mean, coalesce(n, 0) AS n FROM (SELECT DISTINCT ex_i, roi_i FROM r) JOIN (SELECT DISTINCT ex_i, colocal_id FROM r) USING (ex_i) LEFT JOIN m USING (ex_i, roi_i, colocal_id)""")
def roi_channel_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean intensity of every region and channel of an example; region 0 is the background, 0 where they don't meet."""
    out = o.scaffold_means(objects(spark, d), ["ex_i"], "roi_i", "colocal_id", "intensity_mean")
    return out.select("ex_i", "roi_i", "colocal_id", F.round("intensity_mean", 6).alias("intensity_mean"), "n")


@query("SELECT obj_id, greatest(axis_major_length, axis_minor_length) AS longest, area * intensity_mean AS integrated, round(axis_major_length / nullif(axis_minor_length, 0), 6) AS aspect FROM {OBJ} WHERE axis_major_length IS NOT NULL AND NOT isnan(axis_major_length) AND NOT isnan(axis_minor_length)")
def derived_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = objects(spark, d).where("axis_major_length IS NOT NULL AND axis_minor_length IS NOT NULL")
    return rows.select("obj_id", F.array_max(F.array("axis_major_length", "axis_minor_length")).alias("longest"), (F.col("area") * F.col("intensity_mean")).alias("integrated"), F.round(F.try_divide("axis_major_length", "axis_minor_length"), 6).alias("aspect"))


@query(r"""SELECT DISTINCT ex_i, regexp_extract(replace(image_path, '\', '/'), '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(replace(image_path, '\', '/'), '([^/]*)$', 1), '\.[^.]*$', '') AS stem, regexp_extract(image_path, '(\.[^./]*)$', 1) AS suffix,
CASE WHEN regexp_extract(ex_i, '(\d+)', 1) <> '' THEN lpad(regexp_extract(ex_i, '(\d+)', 1), greatest(4, length(regexp_extract(ex_i, '(\d+)', 1)))::INT, '0') END AS number, strftime(acquired_at, '%Y-%m-%d') AS day, CAST(dayofweek(acquired_at) + 1 AS INT) AS weekday, CAST(hour(acquired_at) AS INT) AS hour FROM exmd WHERE image_path IS NOT NULL""")
def example_paths(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("acquired_at")
    parts = o.path_parts(F.col("image_path"))
    return table(spark, d, "exmd").where("image_path IS NOT NULL").select("ex_i", *[c.alias(n) for n, c in parts.items()], o.padded_number(F.col("ex_i")).alias("number"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.dayofweek(at).alias("weekday"), F.hour(at).alias("hour")).distinct()


@query("""WITH p AS (SELECT poly_id, list_transform(ring, lambda v: {'x': v.x * 0.5, 'y': greatest(0, least(512, 512 - v.y)) * 0.25}) AS ring FROM {POLY} WHERE len(ring) > 2)
SELECT poly_id, round(list_min(list_transform(ring, lambda v: v.x)), 6) AS x_min, round(list_max(list_transform(ring, lambda v: v.y)), 6) AS y_max, round(list_sum(list_transform(ring, lambda v: v.x + v.y)), 4) AS total FROM p WHERE len(list_filter(ring, lambda v: v.x IS NULL OR v.y IS NULL)) = 0""")
def scaled_polygons(spark: SparkSession, d: str) -> DataFrame:
    rows = polygons(spark, d).where(F.size("ring") > 2).where(F.forall("ring", lambda v: v["x"].isNotNull() & v["y"].isNotNull()))
    rows = rows.select("poly_id", o.scaled_ring(o.flipped_ring(F.col("ring"), F.lit(512.0)), 0.5, 0.25).alias("ring"))
    total = F.aggregate("ring", F.lit(0.0), lambda t, v: t + v["x"] + v["y"])
    return rows.select("poly_id", F.round(F.array_min(F.transform("ring", lambda v: v["x"])), 6).alias("x_min"), F.round(F.array_max(F.transform("ring", lambda v: v["y"])), 6).alias("y_max"), F.round(total, 4).alias("total"))


@query("""WITH p AS (SELECT ex_i, poly_id, c, y, x FROM {PIX}) SELECT a.ex_i, a.poly_id, count(*) FILTER (hit) AS inside, count(*) FILTER (NOT hit) AS outside FROM (SELECT p.*, EXISTS (SELECT 1 FROM p q WHERE q.ex_i = p.ex_i AND q.y = p.y AND q.x = p.x AND q.c IN (1, 2)) AS hit FROM p WHERE c = 0) a GROUP BY ALL""")
def area_outside_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of channel 0's objects inside and outside the union of the objects of channels 1 and 2."""
    runs = _runs(spark, d, ["ex", "id", "c"])
    got = o.covered(runs.where("c = 0").drop("c"), runs.where("c IN (1, 2)").drop("c"))
    return got.select(F.col("ex").alias("ex_i"), F.col("id").alias("poly_id"), "inside", "outside")


@query("""WITH m AS (SELECT treatment, animal_number, colocal_id AS region, avg(intensity_mean) AS v FROM {OBJ} JOIN (SELECT DISTINCT ex_i, animal_number, treatment FROM exmd) e USING (ex_i) WHERE treatment IS NOT NULL AND animal_number IS NOT NULL AND colocal_id IS NOT NULL AND intensity_mean IS NOT NULL GROUP BY ALL),
c AS (SELECT a.treatment, a.region AS region_a, b.region AS region_b, corr(a.v, b.v) AS r, count(*) AS n FROM m a JOIN m b USING (treatment, animal_number) WHERE a.region < b.region GROUP BY ALL HAVING count(*) >= 4)
SELECT p.treatment AS group_a, q.treatment AS group_b, p.region_a, p.region_b, round(p.r, 6) AS r_a, round(q.r, 6) AS r_b, p.n AS n_a, q.n AS n_b, round((atanh(p.r) - atanh(q.r)) / sqrt(1.0 / (p.n - 3) + 1.0 / (q.n - 3)), 4) AS z FROM c p JOIN c q ON p.region_a = q.region_a AND p.region_b = q.region_b AND p.treatment < q.treatment""")
def region_correlation_run(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of channels over animals in each treatment, and the z of their difference between treatments."""
    meta = table(spark, d, "exmd").select("ex_i", "animal_number", "treatment").distinct()
    c = o.correlations_by_group(objects(spark, d).join(meta, "ex_i"), "treatment", "animal_number", "colocal_id", "intensity_mean")
    q = c.withColumnsRenamed({"treatment": "group_b", "r": "r_b", "n": "n_b"})
    both = c.withColumnsRenamed({"treatment": "group_a", "r": "r_a", "n": "n_a"}).join(q, ["region_a", "region_b"]).where("group_a < group_b")
    z = (F.atanh("r_a") - F.atanh("r_b")) / F.sqrt(1.0 / (F.col("n_a") - 3) + 1.0 / (F.col("n_b") - 3))
    return both.select("group_a", "group_b", "region_a", "region_b", F.round("r_a", 6).alias("r_a"), F.round("r_b", 6).alias("r_b"), "n_a", "n_b", F.round(z, 4).alias("z"))


_RADII = [2.0, 4.0, 8.0]


@query("""WITH p AS (SELECT n.*, e.eccentricity FROM {NBR} n JOIN (SELECT obj_id, CASE WHEN NOT isnan(eccentricity) THEN eccentricity END AS eccentricity FROM {OBJ}) e USING (obj_id)),
k AS (SELECT a.obj_id AS id, r.radius, a.f AS f0, b.f AS f1, a.eccentricity AS e0, b.eccentricity AS e1 FROM p a JOIN p b ON a.key = b.key AND a.obj_id <> b.obj_id JOIN (VALUES (2.0), (4.0), (8.0)) r(radius) ON pow(a.a - b.a, 2) + pow(a.b - b.b, 2) + pow(a.c - b.c, 2) <= radius * radius),
s AS (SELECT radius, 'f' AS feature, id, count(f1) AS n, avg(f1) - any_value(f0) AS delta FROM k GROUP BY ALL UNION ALL SELECT radius, 'eccentricity', id, count(e1), avg(e1) - any_value(e0) FROM k GROUP BY ALL)
SELECT CAST(radius AS DOUBLE) AS radius, feature, count(*) AS centres, round(avg(n), 6) AS mean_neighbours, round(median(delta), 6) AS median_delta FROM s WHERE n > 0 GROUP BY radius, feature""")
def neighbourhood_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per radius and feature: objects with neighbours, their mean number, and the median of how neighbours differ from the object."""
    rows = _placed(spark, d).join(objects(spark, d).select("obj_id", "eccentricity"), "obj_id")
    links = both_ways(near_pairs(rows, "obj_id", [F.col(c) for c in "abc"], [F.col("key")], max(_RADII)))
    at = lambda n: rows.select(F.col("obj_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in "abc"])
    gap = sum(((F.col(f"id_{c}") - F.col(f"neighbour_{c}")) * (F.col(f"id_{c}") - F.col(f"neighbour_{c}")) for c in "abc"), F.lit(0.0))
    links = links.join(at("id"), "id").join(at("neighbour"), "neighbour").select("id", "neighbour", F.sqrt(gap).alias("distance"))
    run = o.neighbourhood_run(links, rows, "obj_id", ["f", "eccentricity"], _RADII)
    mid = percentiles(run, ["radius", "feature"], "delta", [0.5], "q")
    counts = run.groupBy("radius", "feature").agg(F.count(F.lit(1)).alias("centres"), F.round(F.avg("n"), 6).alias("mean_neighbours"))
    return counts.join(mid, ["radius", "feature"]).select("radius", "feature", "centres", "mean_neighbours", F.round(F.col("q")[0], 6).alias("median_delta"))


@query("""SELECT variable, treatment, 'KO' AS group_a, 'WT' AS group_b, na AS n_a, nb AS n_b, CASE WHEN ma > mb THEN 'KO > WT' WHEN ma < mb THEN 'KO < WT' ELSE 'KO = WT' END AS direction, round((ma - mb) / sqrt(va / na + vb / nb), 5) AS t_welch,
round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d FROM (SELECT variable, treatment, count(value) FILTER (genotype = 'KO') AS na, avg(value) FILTER (genotype = 'KO') AS ma, var_samp(value) FILTER (genotype = 'KO') AS va,
count(value) FILTER (genotype = 'WT') AS nb, avg(value) FILTER (genotype = 'WT') AS mb, var_samp(value) FILTER (genotype = 'WT') AS vb FROM {LONG} WHERE treatment IS NOT NULL GROUP BY ALL) WHERE na > 1 AND nb > 1""")
def batch_test_summary(spark: SparkSession, d: str) -> DataFrame:
    """All variables of all treatments in one pass: sizes, direction, statistic and effect."""
    t = s.two_samples(_long(spark, d).where("treatment IS NOT NULL"), ["variable", "treatment"], "genotype", "KO", "WT", "value").where("n_a > 1 AND n_b > 1")
    sign = F.when(F.col("mean_a") > F.col("mean_b"), "KO > WT").when(F.col("mean_a") < F.col("mean_b"), "KO < WT").otherwise("KO = WT")
    return t.select("variable", "treatment", F.lit("KO").alias("group_a"), F.lit("WT").alias("group_b"), "n_a", "n_b", sign.alias("direction"), F.round("t_welch", 5).alias("t_welch"), F.round("cohens_d", 6).alias("cohens_d"))


@query("""SELECT synapse_id, CAST(is_puncta AS INT) AS is_puncta, CAST(coalesce(genotype = 'KO', false) AS INT) AS genotype_KO, CAST(coalesce(genotype = 'WT', false) AS INT) AS genotype_WT, round((area - avg(area) OVER ()) / stddev_pop(area) OVER (), 6) AS area
FROM (SELECT DISTINCT synapse_id, genotype, is_puncta, area FROM synapse_features WHERE area IS NOT NULL)""")
def groups_as_features(spark: SparkSession, d: str) -> DataFrame:
    """Groups as 0/1 columns and flags as numbers beside a scaled feature, for models that take numbers only."""
    rows = table(spark, d, "synapse_features").select("synapse_id", "genotype", "is_puncta", "area").distinct().where("area IS NOT NULL")
    coded = l.standard_scaled(l.one_hot(rows, "genotype"), ["area"]).withColumn("is_puncta", F.col("is_puncta").cast("int"))
    return coded.select("synapse_id", "is_puncta", "genotype_KO", "genotype_WT", F.round("area", 6).alias("area"))


@query("""WITH h AS (SELECT colocal_id, lo, hi, least(floor(CASE WHEN hi > lo THEN (intensity_mean - lo) * 256 / (hi - lo) ELSE 0 END), 255) AS b, count(*)::DOUBLE AS n FROM (SELECT colocal_id, intensity_mean, min(intensity_mean) OVER p AS lo, max(intensity_mean) OVER p AS hi FROM {OBJ} WHERE intensity_mean IS NOT NULL WINDOW p AS (PARTITION BY colocal_id)) GROUP BY ALL),
s AS (SELECT *, sum(n) OVER u AS w, sum(n * b) OVER u AS sm, sum(n) OVER t AS wt, sum(n * b) OVER t AS st FROM h WINDOW u AS (PARTITION BY colocal_id ORDER BY b), t AS (PARTITION BY colocal_id))
SELECT colocal_id, round(CASE WHEN hi = lo THEN lo ELSE lo + (b + 1) * (hi - lo) / 256 END, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY colocal_id ORDER BY CASE WHEN wt > w THEN w * (wt - w) * pow(sm / w - (st - sm) / (wt - w), 2) ELSE -1 END DESC, b) AS k FROM s) WHERE k = 1""")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    from morphoquarry.operators.morphology import otsu

    return otsu(objects(spark, d).where("intensity_mean IS NOT NULL"), ["colocal_id"], "intensity_mean").select("colocal_id", F.round("threshold", 6).alias("threshold"))


_CLAMP = "CASE WHEN {y} < 0 THEN 0 WHEN {y} > 128 THEN 128 * {y} - 8192 ELSE {y} * {y} / 2 END"


@query(f"""WITH e AS (SELECT poly_id, unnest(ring) AS a, unnest(list_append(ring[2:], ring[1])) AS b FROM {{POLY}} WHERE len(ring) > 2),
c AS (SELECT poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, greatest(0, least(128, a.x)) AS u, greatest(0, least(128, b.x)) AS v FROM e),
h AS (SELECT poly_id, v - u AS w, CASE WHEN x2 <> x1 THEN y1 + (u - x1) * (y2 - y1) / (x2 - x1) ELSE y1 END AS p, CASE WHEN x2 <> x1 THEN y1 + (v - x1) * (y2 - y1) / (x2 - x1) ELSE y1 END AS q FROM c)
SELECT poly_id, round(abs(sum(w * CASE WHEN abs(q - p) < 1e-9 THEN greatest(0, least(128, p)) ELSE (({_CLAMP.format(y="q")}) - ({_CLAMP.format(y="p")})) / (q - p) END)), 3) AS area FROM h GROUP BY poly_id""")
def clipped_area(spark: SparkSession, d: str) -> DataFrame:
    from morphoquarry.operators.geometry import area_in_box

    rows = polygons(spark, d).where(F.size("ring") > 2).select("poly_id", "ring")
    return area_in_box(rows, "ring", (0.0, 0.0, 128.0, 128.0), "area").select("poly_id", F.round("area", 3).alias("area"))
