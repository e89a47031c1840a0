"""Distribution functions and small-sample tests in plain Python."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d, c = num * d + b, b + num / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and t == t else math.nan


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 and f == f else math.nan


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2) if df > 0 and x == x else math.nan


def kolmogorov_sf(d: float, n: float) -> float:
    """Asymptotic two-sided p of the Kolmogorov–Smirnov statistic with effective sample size n."""
    x = d * math.sqrt(n)
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


@lru_cache(maxsize=512)
def _rank_sum_counts(n1: int, n2: int) -> tuple[int, ...]:
    """Number of arrangements by U, by adding one observation at a time."""
    row = [[1] for _ in range(n2 + 1)]
    for i in range(1, n1 + 1):
        new = [[1]]
        for j in range(1, n2 + 1):
            size = i * j + 1
            counts = [0] * size
            for u, v in enumerate(row[j]):
                counts[u + j] += v
            for u, v in enumerate(new[j - 1]):
                counts[u] += v
            new.append(counts)
        row = new
    return tuple(row[n2])


def mann_whitney_p(u: float, n1: int, n2: int, tie_term: float, exact_limit: int = 8) -> float:
    """Two-sided p: exact if there are no ties and a sample has at most 8 values, else normal with tie and continuity correction."""
    if n1 < 1 or n2 < 1:
        return math.nan
    top = max(u, n1 * n2 - u)
    if tie_term == 0 and min(n1, n2) <= exact_limit:
        counts = _rank_sum_counts(n1, n2)
        return min(1.0, 2 * sum(counts[int(math.ceil(top)) :]) / sum(counts))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1))))
    return min(1.0, 2 * normal_sf((top - n1 * n2 / 2 - 0.5) / sd)) if sd > 0 else 1.0


def fisher_exact_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2×2 table: tables no likelier than the given one."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2

    def log_p(x: int) -> float:
        choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
        return choose(r1, x) + choose(r2, c1 - x) - choose(n, c1)

    here = log_p(a)
    return min(1.0, sum(math.exp(v) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (v := log_p(x)) <= here + 1e-7))


# Polynomials of Royston's approximation (1995), constant term first.
_W_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_W_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_W_SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
_W_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_W_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_W_LARGE_SD = (-0.4803, -0.082676, 0.0030302)


def normal_scores(places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Approximate means of the order statistics at places 1 to n of a normal sample of n values (Blom)."""
    return np.fromiter(map(_NORMAL.inv_cdf, (np.asarray(places, float) - 0.375) / (np.asarray(n, float) + 0.25)), float)


def shapiro_from_sums(n: int, mm: float, mx: float, ends: tuple[float, float, float, float], squares: float) -> tuple[float, float]:
    """W and p from sums over a sorted sample: of squared scores, of score times value, its two least and two greatest
    values (ascending) and its squared deviations from the mean. NaN for under 3 values and for constants.

    Royston fitted p on up to 5000 values; beyond, W stays right and p is carried on.
    """
    x1, x2, x3, x4 = ends
    if n < 3 or x1 == x4 or not squares > 0:
        return math.nan, math.nan
    poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
    m1, m2 = normal_scores(np.array([n, n - 1]), np.array([n, n]))
    u = 1 / math.sqrt(n)
    if n == 3:
        ax = math.sqrt(0.5) * (x4 - x1)
    else:
        last = poly(_W_C1, u) + m1 / math.sqrt(mm)
        if n > 5:
            second = poly(_W_C2, u) + m2 / math.sqrt(mm)
            phi = (mm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * second**2)
            ax = (mx - m1 * (x4 - x1) - m2 * (x3 - x2)) / math.sqrt(phi) + last * (x4 - x1) + second * (x3 - x2)
        else:
            ax = (mx - m1 * (x4 - x1)) / math.sqrt((mm - 2 * m1**2) / (1 - 2 * last**2)) + last * (x4 - x1)
    w = min(1.0, ax**2 / squares)
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y, mean, sd = -math.log(gamma - y), poly(_W_SMALL_MEAN, n), math.exp(poly(_W_SMALL_SD, n))
    else:
        mean, sd = poly(_W_LARGE_MEAN, math.log(n)), math.exp(poly(_W_LARGE_SD, math.log(n)))
    return w, normal_sf((y - mean) / sd)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p; NaN for under 3 values and for constants."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    m, d = normal_scores(np.arange(1, n + 1), np.full(n, n)), x - x.mean()
    return shapiro_from_sums(n, float(m @ m), float(m @ d), (x[0], x[1], x[-2], x[-1]), float(d @ d))


def skew_from_moments(n: int, skew: float) -> tuple[float, float]:
    """Z and two-sided p of D'Agostino's test from the population skewness; needs 8 values."""
    if n < 8 or skew != skew:
        return math.nan, math.nan
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    z = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    return z, 2 * normal_sf(abs(z))


def skew_test(values: np.ndarray) -> tuple[float, float]:
    """Z and two-sided p of D'Agostino's test that the skewness is that of a normal distribution; needs 8 values."""
    x = np.asarray(values, float)
    d = x - x.mean() if len(x) else x
    return skew_from_moments(len(x), (d**3).mean() / (d**2).mean() ** 1.5 if (d**2).any() else math.nan)


def wilcoxon_signed_rank(differences: np.ndarray) -> tuple[float, float]:
    """The smaller rank sum and the two-sided normal p with tie correction; zero differences are left out."""
    d = np.asarray(differences, float)
    d = d[(d != 0) & ~np.isnan(d)]
    n = len(d)
    if not n:
        return math.nan, math.nan
    size = np.abs(d)
    kinds, place, counts = np.unique(size, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[place]
    up, down = rank[d > 0].sum(), rank[d < 0].sum()
    variance = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    z = (min(up, down) - n * (n + 1) / 4) / math.sqrt(variance) if variance > 0 else 0.0
    return float(min(up, down)), min(1.0, 2 * normal_sf(abs(z)))
