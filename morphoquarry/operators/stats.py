"""Group comparisons, rank tests, correlations and models, aggregated in the JVM; only p-values of aggregated rows are computed in Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphoquarry.functions import special
from morphoquarry.operators.twostage import carried, parted, percentiles, ranked, stable, with_statistics


def _p(fn, *columns):
    """A p-value column from aggregated columns; NULL in any of them gives NULL."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else _clean(fn(*row)) for row in zip(*series)], dtype=float)

    return F.pandas_udf(run, T.DoubleType())(*columns)


def _clean(p: float) -> float | None:
    return None if p != p else p


def two_samples(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    """Per key: n, mean and variance of both groups, Student's and Welch's t with degrees of freedom, Cohen's d and Hedges' g.

    Rows without a value or in other groups don't count. Statistics that need more values than there are, or a variance
    above 0, are NULL.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    side = lambda g, f: f(F.when(F.col(group) == g, v))
    s = df.where(F.col(group).isin(a, b)).groupBy(*keys).agg(
        *[side(g, f).alias(f"{n}_{x}") for x, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("var_a"), F.col("var_b")
    gap = F.col("mean_a") - F.col("mean_b")
    pooled = F.try_divide((na - 1) * va + (nb - 1) * vb, (na + nb - 2).cast("double"))
    per_a, per_b = F.try_divide(va, na.cast("double")), F.try_divide(vb, nb.cast("double"))
    d = F.try_divide(gap, F.sqrt(pooled))
    return s.withColumns(
        {
            "t_student": F.try_divide(gap, F.sqrt(pooled * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb)))),
            "df_student": (na + nb - 2).cast("double"),
            "t_welch": F.try_divide(gap, F.sqrt(per_a + per_b)),
            "df_welch": F.try_divide((per_a + per_b) * (per_a + per_b), F.try_divide(per_a * per_a, (na - 1).cast("double")) + F.try_divide(per_b * per_b, (nb - 1).cast("double"))),
            "cohens_d": d,
            "hedges_g": d * (1 - F.try_divide(F.lit(3.0), 4.0 * (na + nb) - 9)),
        }
    )


def with_t_p(df: DataFrame) -> DataFrame:
    return df.withColumns({"p_student": _p(special.t_two_sided, "t_student", "df_student"), "p_welch": _p(special.t_two_sided, "t_welch", "df_welch")})


def anova(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """One-way: groups, n, F, eta2, p per key, from sums of squares; groups that are NULL don't count."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    total = F.sum(F.col("_n") * F.col("_m"))
    s = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_v")).alias("within"), (F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - F.try_divide(total * total, F.sum("_n"))).alias("between"))
    s = s.withColumn("f", F.try_divide(F.try_divide(F.col("between"), (F.col("groups") - 1).cast("double")), F.try_divide(F.col("within"), (F.col("n") - F.col("groups")).cast("double"))))
    s = s.withColumn("eta2", F.try_divide(F.col("between"), F.col("between") + F.col("within")))
    return s.withColumn("p", _p(special.f_sf, "f", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double"))).drop("within", "between")


def levene(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Median-centred: the analysis of variance of distances to the group's median."""
    medians = percentiles(df.where(F.col(group).isNotNull()), [*keys, group], value, [0.5], "_median")
    away = df.join(medians, [*keys, group]).withColumn("_away", F.abs(F.col(value) - F.col("_median")[0]))
    return anova(away, keys, group, "_away").withColumnRenamed("f", "w").drop("eta2")


def mann_whitney(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    """(keys, n_a, n_b, u, p): U of the first group, two-sided p."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(*keys, group, value)
    r = ranked(rows, keys, value)
    s = r.groupBy(*keys).agg(F.count(F.when(F.col(group) == a, 1)).alias("n_a"), F.count(F.when(F.col(group) == b, 1)).alias("n_b"), F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("_r"), F.sum(F.col("_ties") * F.col("_ties") - 1).cast("double").alias("_t"))
    s = s.withColumn("u", F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    return s.withColumn("p", _p(lambda u, x, y, t: special.mann_whitney_p(u, int(x), int(y), t), "u", "n_a", "n_b", "_t")).drop("_r", "_t")


def kruskal(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """(keys, groups, n, h, eps2, p) with tie correction."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(*keys, group, value)
    r = ranked(rows, keys, value)
    per = r.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"), F.sum("rank").alias("_r"), F.sum(F.col("_ties") * F.col("_ties") - 1).cast("double").alias("_t"))
    s = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("n"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), F.sum("_t").alias("_t"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    s = s.withColumn("h", F.try_divide(raw, 1 - F.try_divide(F.col("_t"), n * n * n - n)))
    s = s.withColumn("eps2", F.try_divide(F.col("h") * (n + 1), n * n - 1))
    return s.withColumn("p", _p(special.chi2_sf, "h", (F.col("groups") - 1).cast("double"))).drop("_s", "_t")


def ks_two_samples(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    """(keys, n_a, n_b, d, p): the greatest gap between the empirical distributions, asymptotic p.

    Values are first counted, then accumulated range by range.
    """
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    counted = rows.groupBy(*keys, value).agg(F.count(F.when(F.col(group) == a, 1)).alias("_a"), F.count(F.when(F.col(group) == b, 1)).alias("_b"))
    rows = with_statistics(parted(counted, keys, value), keys, {"n_a": F.sum("_a"), "n_b": F.sum("_b")})
    below = carried(rows, keys, {"_ba": F.sum("_a"), "_bb": F.sum("_b")})
    here = Window.partitionBy(*keys, "_range").orderBy(value)
    upto = below.withColumns({"_ca": F.coalesce("_ba", F.lit(0)) + F.sum("_a").over(here), "_cb": F.coalesce("_bb", F.lit(0)) + F.sum("_b").over(here)})
    gap = F.abs(F.try_divide("_ca", "n_a") - F.try_divide("_cb", "n_b"))
    s = upto.groupBy(*keys).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(gap).alias("d"))
    return s.withColumn("p", _p(lambda d, x, y: special.kolmogorov_sf(d, x * y / (x + y)), "d", "n_a", "n_b"))


def chi_square_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Pearson's statistic without continuity correction. Products of counts go beyond 64 bits from some 50 000 a cell on."""
    whole, real = (lambda v: v.cast("decimal(19,0)")), (lambda v: v.cast("double"))
    cross = real(whole(a) * whole(d) - whole(b) * whole(c))
    return F.try_divide(real(a + b + c + d) * (cross * cross), real(a + b) * real(c + d) * real(a + c) * real(b + d))


def with_table_p(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    chi = df.withColumn("chi2", chi_square_2x2(F.col(a), F.col(b), F.col(c), F.col(d)))
    return chi.withColumns({"p_chi2": _p(lambda x: special.chi2_sf(x, 1), "chi2"), "p_fisher": _p(lambda *t: special.fisher_exact_p(*map(int, t)), a, b, c, d)})


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; NULL where a deviation is 0. Both columns must be present in the rows aggregated."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_pairs(df: DataFrame, keys: list[str], subject: str, item: str, value: str) -> DataFrame:
    """(keys, item_a < item_b, n, r, p) over subjects that have both items; several rows of a subject and item are averaged."""
    per = df.where(F.col(value).isNotNull() & F.col(item).isNotNull() & F.col(subject).isNotNull()).groupBy(*keys, subject, item).agg(F.avg(value).alias("_v"))
    a = per.withColumnsRenamed({item: f"{item}_a", "_v": "_x"})
    b = per.withColumnsRenamed({item: f"{item}_b", "_v": "_y"})
    pairs = a.join(b, [*keys, subject]).where(F.col(f"{item}_a") < F.col(f"{item}_b"))
    r = pairs.groupBy(*keys, f"{item}_a", f"{item}_b").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("_x"), F.col("_y")).alias("r"))
    return r.withColumn("p", _p(lambda v, n: special.t_two_sided(v * math.sqrt((n - 2) / max(1e-300, 1 - v * v)), n - 2) if n >= 3 else math.nan, "r", "n"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho) over rows with both values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    both = ranked(ranked(rows, keys, x, "_rx").drop("_ties"), keys, y, "_ry").drop("_ties")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("_rx"), F.col("_ry")).alias("rho"))


def fisher_z(r: Column) -> Column:
    return F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))


def compare_correlations(df: DataFrame, r_a: str, n_a: str, r_b: str, n_b: str) -> DataFrame:
    """Adds z and p of the difference of two correlations; NULL if a sample has fewer than 4."""
    error = F.sqrt(1 / (F.col(n_a) - 3).cast("double") + 1 / (F.col(n_b) - 3).cast("double"))
    enough = (F.col(n_a) >= 4) & (F.col(n_b) >= 4)
    z = F.when(enough, (fisher_z(F.col(r_a)) - fisher_z(F.col(r_b))) / error)
    return df.withColumn("z", z).withColumn("p", _p(lambda v: 2 * special.normal_sf(abs(v)), "z"))


def gram(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray]:
    """Rows with all features, and the sums of products of each pair, in one pass."""
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna()
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(features), len(features)))
    for i, j in pairs:
        out[i, j] = out[j, i] = got[f"s{i}_{j}"] or 0.0
    return got["n"], out


def variance_inflation(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, vif) without an intercept: each feature's sum of squares times its entry in the inverse of the Gram matrix."""
    _, g = gram(df, features)
    vif = np.diag(np.linalg.pinv(g)) * np.diag(g)
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, vif)], "feature string, vif double")


def random_intercept_model(df: DataFrame, subject: str, response: str, features: list[str]) -> DataFrame:
    """A linear model with an intercept per subject, by restricted likelihood: (term, estimate, std_error), the variances and the share explained.

    Subjects are reduced to sums of products first, so the fit works on one small matrix per subject, added up per
    number of rows; rows with a NULL are left out. Terms: intercept, features, var_subject, var_residual, r2_marginal.
    """
    names = ["_one", *features, response]
    rows = df.select(subject, F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in [*features, response]]).dropna()
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    per = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs])
    # by subject size, the pooled products and the products of the subjects' sums are all that the likelihood needs
    sums = per.groupBy("n").agg(F.count(F.lit(1)).alias("m"), *[F.sum(f"s{i}_{j}").alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s0_{i}") * F.col(f"s0_{j}")).alias(f"b{i}_{j}") for i, j in pairs]).toPandas()

    def full(row, letter):
        out = np.zeros((k, k))
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"{letter}{i}_{j}"]
        return out

    parts = [(int(r["n"]), int(r["m"]), full(r, "a"), full(r, "b")) for _, r in sums.iterrows()]
    total = sum(n * m for n, m, _, _ in parts)
    p = k - 1

    def solve(ratio: float):
        s = sum(a - ratio / (1 + n * ratio) * b for n, _, a, b in parts)
        beta = np.linalg.pinv(s[:p, :p]) @ s[:p, p]
        rss = max(s[p, p] - s[:p, p] @ beta, 1e-300)
        sigma2 = rss / (total - p)
        penalty = sum(m * math.log1p(n * ratio) for n, m, _, _ in parts) + np.linalg.slogdet(s[:p, :p])[1]
        return (total - p) * math.log(sigma2) + penalty, beta, sigma2, s

    grid = [0.0, *np.exp(np.linspace(-12, 8, 161))]
    at = min(range(len(grid)), key=lambda i: solve(grid[i])[0])
    low, high = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    for _ in range(80):
        third = (high - low) / 3
        if solve(low + third)[0] <= solve(high - third)[0]:
            high -= third
        else:
            low += third
    ratio = (low + high) / 2
    _, beta, sigma2, s = solve(ratio)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(s[:p, :p])) * sigma2, 0))
    whole = sum(a for _, _, a, _ in parts)
    mean = whole[0, :p] / total
    spread = whole[:p, :p] / total - np.outer(mean, mean)
    fixed = float(beta @ spread @ beta)
    rows_out = [(t, float(v), float(e)) for t, v, e in zip(["intercept", *features], beta, errors)]
    rows_out += [("var_subject", float(ratio * sigma2), None), ("var_residual", float(sigma2), None), ("r2_marginal", float(fixed / (fixed + ratio * sigma2 + sigma2)), None)]
    return df.sparkSession.createDataFrame(rows_out, "term string, estimate double, std_error double")


def shapiro_by_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, w, p_normal, skew_z, p_skew) per group of any size, NULL keys included, without gathering a group; NULL where there are too few values or no spread."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    with_n = with_statistics(rows, keys, {"_n": F.count(F.lit(1)), "_mean": F.avg("_v")})
    placed = carried(parted(with_n, keys, "_v"), keys, {"_below": F.count(F.lit(1))})
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_v"))
    placed = placed.withColumn("_i", F.coalesce("_below", F.lit(0)) + local)
    scores = F.pandas_udf(lambda i, n: pd.Series(special.normal_scores(i, n)), T.DoubleType())
    scored = placed.withColumn("_m", scores(F.col("_i"), F.col("_n"))).withColumn("_d", F.col("_v") - F.col("_mean"))
    at = lambda place: F.max(F.when(F.col("_i") == place, F.col("_v")))
    sums = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        F.sum(F.col("_m") * F.col("_d")).alias("_mx"),
        F.sum(F.col("_d") * F.col("_d")).alias("_dd"),
        F.skewness("_v").alias("_skew"),
        *[at(p).alias(f"_x{k}") for k, p in enumerate((F.lit(1), F.lit(2), F.col("_n") - 1, F.col("_n")))],
    )
    shapiro = lambda k: _p(lambda n, mm, mx, a, b, c, d, dd: special.shapiro_from_sums(n, mm, mx, (a, b, c, d), dd)[k], "n", "_mm", "_mx", "_x0", "_x1", "_x2", "_x3", "_dd")
    skew = lambda k: _p(lambda n, s: special.skew_from_moments(n, s)[k], "n", "_skew")
    return stable(sums).select(*keys, "n", shapiro(0).alias("w"), shapiro(1).alias("p_normal"), skew(0).alias("skew_z"), skew(1).alias("p_skew"))
