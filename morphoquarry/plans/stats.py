"""Statistics of groups: tests, effect sizes, correlations, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import stats as s
from morphoquarry.operators.windows import adjusted
from morphoquarry.sources.tables import OBJECTS_SQL, objects, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.replace("{OBJ}", OBJECTS_SQL).replace("{SYN}", SYN_SQL)
        return fn

    return add


SYN_SQL = "(SELECT DISTINCT synapse_id, genotype, treatment, sex, intensity_mean, area, eccentricity, intensity_std FROM synapse_features)"
FEATURES = ["intensity_mean", "area", "eccentricity", "intensity_std"]


def _synapses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "synapse_features").select("synapse_id", "genotype", "treatment", "sex", *FEATURES).distinct()


def _long(spark: SparkSession, d: str) -> DataFrame:
    return _synapses(spark, d).unpivot(["synapse_id", "genotype", "treatment"], FEATURES, "variable", "value").where("value IS NOT NULL")


LONG_SQL = "(" + " UNION ALL ".join(f"SELECT synapse_id, genotype, treatment, '{f}' AS variable, {f} AS value FROM {{SYN}} WHERE {f} IS NOT NULL" for f in FEATURES) + ")"
_MOMENTS = f"""m AS (SELECT variable, count(value) FILTER (genotype = 'KO') AS na, avg(value) FILTER (genotype = 'KO') AS ma, var_samp(value) FILTER (genotype = 'KO') AS va,
count(value) FILTER (genotype = 'WT') AS nb, avg(value) FILTER (genotype = 'WT') AS mb, var_samp(value) FILTER (genotype = 'WT') AS vb FROM {LONG_SQL} GROUP BY variable)"""


@query(f"""WITH {_MOMENTS} SELECT variable, na AS n_a, nb AS n_b, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 6) AS t_student,
round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t_welch, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df_welch FROM m""")
def ttest_stats(spark: SparkSession, d: str) -> DataFrame:
    t = s.two_samples(_long(spark, d), ["variable"], "genotype", "KO", "WT", "value")
    return t.select("variable", "n_a", "n_b", F.round("t_student", 6).alias("t_student"), F.round("t_welch", 6).alias("t_welch"), F.round("df_welch", 4).alias("df_welch"))


@query(f"""WITH {_MOMENTS} SELECT variable, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d,
round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3.0 / (4.0 * (na + nb) - 9)), 6) AS hedges_g, round(ma / mb, 6) AS ratio FROM m""")
def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    t = s.two_samples(_long(spark, d), ["variable"], "genotype", "KO", "WT", "value")
    return t.select("variable", F.round("cohens_d", 6).alias("cohens_d"), F.round("hedges_g", 6).alias("hedges_g"), F.round(F.try_divide("mean_a", "mean_b"), 6).alias("ratio"))


@query()
def ttest_p_values(spark: SparkSession, d: str) -> DataFrame:
    t = s.with_t_p(s.two_samples(_long(spark, d), ["variable", "treatment"], "genotype", "KO", "WT", "value"))
    return adjusted(t, "p_welch", [], out="q_welch").select("variable", "treatment", "n_a", "n_b", "t_student", "p_student", "t_welch", "p_welch", "q_welch")


_ANOVA = """p AS (SELECT variable, genotype, count(*) AS n, avg({v}) AS m, var_pop({v}) AS v FROM {src} WHERE genotype IS NOT NULL GROUP BY ALL),
a AS (SELECT variable, count(*) AS g, sum(n) AS n, sum(n * v) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b FROM p GROUP BY variable)"""


@query(f"WITH {_ANOVA.format(v='value', src=LONG_SQL)} SELECT variable, round((b / (g - 1)) / (w / (n - g)), 3) AS f, round(b / (b + w), 6) AS eta2 FROM a".replace("{{SYN}}", "{SYN}"))
def anova_f_eta2(spark: SparkSession, d: str) -> DataFrame:
    return s.anova(_long(spark, d), ["variable"], "genotype", "value").select("variable", F.round("f", 3).alias("f"), F.round("eta2", 6).alias("eta2"))


@query(f"""WITH x AS (SELECT variable, genotype, abs(value - median(value) OVER (PARTITION BY variable, genotype)) AS away FROM {LONG_SQL}), {_ANOVA.format(v='away', src='x')}
SELECT variable, round((b / (g - 1)) / (w / (n - g)), 4) AS w FROM a""")
def levene_w(spark: SparkSession, d: str) -> DataFrame:
    return s.levene(_long(spark, d), ["variable"], "genotype", "value").select("variable", F.round("w", 4).alias("w"))


_RANKS = f"r AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY variable, value) AS t FROM {LONG_SQL}"


@query(f"""WITH {_RANKS} WHERE genotype IN ('KO', 'WT')) SELECT variable, count(*) FILTER (genotype = 'KO') AS n_a, count(*) FILTER (genotype = 'WT') AS n_b,
CAST(sum(k) FILTER (genotype = 'KO') - count(*) FILTER (genotype = 'KO') * (count(*) FILTER (genotype = 'KO') + 1) / 2 AS DOUBLE) AS u FROM r GROUP BY variable""")
def mwu_u(spark: SparkSession, d: str) -> DataFrame:
    return s.mann_whitney(_long(spark, d), ["variable"], "genotype", "KO", "WT", "value").select("variable", "n_a", "n_b", "u")


@query(f"""WITH {_RANKS} WHERE genotype IS NOT NULL), g AS (SELECT variable, genotype, count(*) AS n, sum(k) AS s, sum(CAST(t AS DOUBLE) * t - 1) AS t FROM r GROUP BY ALL), a AS (SELECT variable, CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS s, sum(t) AS t FROM g GROUP BY variable)
SELECT variable, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS h, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) * (n + 1) / (n * n - 1), 6) AS eps2 FROM a""")
def kruskal_h_eps2(spark: SparkSession, d: str) -> DataFrame:
    return s.kruskal(_long(spark, d), ["variable"], "genotype", "value").select("variable", F.round("h", 4).alias("h"), F.round("eps2", 6).alias("eps2"))


@query(f"""WITH c AS (SELECT variable, value, count(*) FILTER (genotype = 'KO') AS a, count(*) FILTER (genotype = 'WT') AS b FROM {LONG_SQL} WHERE genotype IN ('KO', 'WT') GROUP BY ALL),
w AS (SELECT variable, sum(a) OVER o / sum(a) OVER p AS fa, sum(b) OVER o / sum(b) OVER p AS fb FROM c WINDOW o AS (PARTITION BY variable ORDER BY value), p AS (PARTITION BY variable)) SELECT variable, round(max(abs(fa - fb)), 9) AS d FROM w GROUP BY variable""")
def ks_2samp_d(spark: SparkSession, d: str) -> DataFrame:
    return s.ks_two_samples(_long(spark, d), ["variable"], "genotype", "KO", "WT", "value").select("variable", F.round("d", 9).alias("d"))


@query()
def rank_test_p_values(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    m = s.mann_whitney(long, ["variable"], "genotype", "KO", "WT", "value").select("variable", F.col("p").alias("p_mann_whitney"))
    k = s.kruskal(long, ["variable"], "genotype", "value").select("variable", F.col("p").alias("p_kruskal"))
    return m.join(k, "variable").join(s.ks_two_samples(long, ["variable"], "genotype", "KO", "WT", "value").select("variable", F.col("p").alias("p_ks")), "variable", "full_outer")


@query()
def normality_tests(spark: SparkSession, d: str) -> DataFrame:
    return s.shapiro_by_group(_long(spark, d), ["variable", "genotype", "treatment"], "value")


@query("""WITH t AS (SELECT count(*) FILTER (genotype = 'KO' AND sex = 'female') AS a, count(*) FILTER (genotype = 'KO' AND sex = 'male') AS b, count(*) FILTER (genotype = 'WT' AND sex = 'female') AS c, count(*) FILTER (genotype = 'WT' AND sex = 'male') AS d FROM {SYN})
SELECT a, b, c, d, round(CAST(a + b + c + d AS DOUBLE) * pow(CAST(a * d - b * c AS DOUBLE), 2) / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)), 6) AS chi2 FROM t""")
def chi_square(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda g, x: F.count(F.when((F.col("genotype") == g) & (F.col("sex") == x), 1))
    t = _synapses(spark, d).agg(cell("KO", "female").alias("a"), cell("KO", "male").alias("b"), cell("WT", "female").alias("c"), cell("WT", "male").alias("d"))
    return s.with_table_p(t, "a", "b", "c", "d").select("a", "b", "c", "d", F.round("chi2", 6).alias("chi2"))


_CORR_SQL = """(SELECT o.treatment, o.animal_number, o.region, avg(o.v) AS v FROM (SELECT treatment, animal_number, coalesce(roi_i, 0) * 10 + colocal_id AS region, intensity_mean AS v FROM {OBJ} JOIN exmd USING (ex_i) WHERE intensity_mean IS NOT NULL AND treatment IS NOT NULL) o GROUP BY ALL)"""
_PAIRS_SQL = f"""(SELECT a.treatment, a.region AS region_a, b.region AS region_b, count(*) AS n, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS r FROM {_CORR_SQL} a JOIN {_CORR_SQL} b ON a.treatment = b.treatment AND a.animal_number = b.animal_number AND a.region < b.region GROUP BY ALL)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "exmd").select("ex_i", "treatment", "animal_number").where("treatment IS NOT NULL")
    rows = objects(spark, d).join(meta, "ex_i").select("treatment", "animal_number", (F.coalesce("roi_i", F.lit(0)) * 10 + F.col("colocal_id")).alias("region"), "intensity_mean")
    return s.correlation_pairs(rows, ["treatment"], "animal_number", "region", "intensity_mean")


@query(f"SELECT treatment, region_a, region_b, n, round(r, 6) AS r FROM {_PAIRS_SQL}")
def corr_pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("treatment", "region_a", "region_b", "n", F.round("r", 6).alias("r"))


@query("""WITH x AS (SELECT genotype, rank() OVER p + (count(*) OVER (PARTITION BY genotype, intensity_mean) - 1) / 2.0 AS rx, rank() OVER q + (count(*) OVER (PARTITION BY genotype, area) - 1) / 2.0 AS ry FROM {SYN} WHERE intensity_mean IS NOT NULL AND area IS NOT NULL AND genotype IS NOT NULL
WINDOW p AS (PARTITION BY genotype ORDER BY intensity_mean), q AS (PARTITION BY genotype ORDER BY area)) SELECT genotype, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM x GROUP BY genotype""")
def corr_spearman(spark: SparkSession, d: str) -> DataFrame:
    return s.spearman(_synapses(spark, d).where("genotype IS NOT NULL"), ["genotype"], "intensity_mean", "area").withColumn("rho", F.round("rho", 6))


@query(f"""WITH p AS (SELECT * FROM {_PAIRS_SQL}) SELECT a.region_a, a.region_b, CASE WHEN a.n >= 4 AND b.n >= 4 THEN round((atanh(greatest(least(a.r, 0.999999), -0.999999)) - atanh(greatest(least(b.r, 0.999999), -0.999999))) / sqrt(1.0 / (a.n - 3) + 1.0 / (b.n - 3)), 5) END AS z
FROM p a JOIN p b USING (region_a, region_b) WHERE a.treatment = 'vehicle' AND b.treatment = 'enriched'""".replace("1.0 / (a.n - 3)", "1.0 / nullif(a.n - 3, 0)").replace("1.0 / (b.n - 3)", "1.0 / nullif(b.n - 3, 0)"))
def fisher_z_compare(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    a, b = (p.where(F.col("treatment") == t).select("region_a", "region_b", F.col("n").alias(f"n_{x}"), F.col("r").alias(f"r_{x}")) for x, t in (("a", "vehicle"), ("b", "enriched")))
    both = a.join(b, ["region_a", "region_b"])
    safe = both.withColumns({"n_a": F.when(F.col("n_a") >= 4, F.col("n_a")), "n_b": F.when(F.col("n_b") >= 4, F.col("n_b"))})
    return s.compare_correlations(safe, "r_a", "n_a", "r_b", "n_b").select("region_a", "region_b", F.round("z", 5).alias("z"))


@query("SELECT genotype, round(regr_slope(area, intensity_mean), 9) AS slope, round(regr_intercept(area, intensity_mean), 6) AS intercept, round(corr(area, intensity_mean), 6) AS r FROM {SYN} WHERE area IS NOT NULL AND intensity_mean IS NOT NULL GROUP BY genotype")
def ols_slope(spark: SparkSession, d: str) -> DataFrame:
    rows = _synapses(spark, d).dropna(subset=["area", "intensity_mean"])
    return rows.groupBy("genotype").agg(F.round(F.regr_slope("area", "intensity_mean"), 9).alias("slope"), F.round(F.regr_intercept("area", "intensity_mean"), 6).alias("intercept"), F.round(s.correlation(F.col("area"), F.col("intensity_mean")), 6).alias("r"))


def _minor(m: list[list[str]], i: int) -> list[list[str]]:
    return [[v for c, v in enumerate(row) if c != i] for r, row in enumerate(m) if r != i]


def _determinant(m: list[list[str]]) -> str:
    """The determinant of a matrix of SQL terms, by its first row."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if j % 2 else '+'} {v} * ({_determinant([row[:j] + row[j + 1 :] for row in m[1:]])})" for j, v in enumerate(m[0])]
    return " ".join(parts)


_GRAM = [[f"g{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
_VIF = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(g{i}{i} * ({_determinant(_minor(_GRAM, i))}) / ({_determinant(_GRAM)}), 4) AS vif FROM g" for i, f in enumerate(FEATURES))


@query(f"WITH g AS (SELECT {', '.join(f'sum({a} * {b}) AS g{i}{j}' for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j)} FROM {{SYN}} WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}) {_VIF}")
def vif_gram(spark: SparkSession, d: str) -> DataFrame:
    return s.variance_inflation(_synapses(spark, d), FEATURES).withColumn("vif", F.round("vif", 4))


@query()
def mixed_model(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "exmd").select("ex_i", "animal_number")
    rows = objects(spark, d).join(meta, "ex_i").select("animal_number", "intensity_mean", "eccentricity", F.log("axis_major_length").alias("log_length"))
    return s.random_intercept_model(rows, "animal_number", "intensity_mean", ["eccentricity", "log_length"])


@query("SELECT event_id, CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS mark FROM (SELECT event_id, value / 400 AS p FROM events) WHERE p IS NOT NULL")
def significance_stars(spark: SparkSession, d: str) -> DataFrame:
    from morphoquarry.operators.reshape import stars

    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", stars(F.col("value") / 400).alias("mark"))
