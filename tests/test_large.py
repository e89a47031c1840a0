"""Operators at sizes, or on repeated input, where an earlier form failed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphoquarry.operators import learn, stats


def test_chi_square_of_large_counts(spark):
    rows = [(75_001, 74_000, 73_000, 76_002), (10, 20, 30, 40), (3_000_000_000, 5_000_000_000, 4_000_000_001, 6_000_000_000)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(stats.chi_square_2x2(*map(F.col, "abcd"))).collect()]
    assert got == pytest.approx([(a + b + c + d) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) for a, b, c, d in rows], rel=1e-12)


def test_medoids_by_cells(spark):
    rng = np.random.default_rng(4)
    groups = np.concatenate([rng.normal(m, s, (400, 3)) for m, s in ((0, 1), (6, 2), (-7, 0.5))])
    for points in (groups, np.concatenate([groups, groups[:300]]), np.repeat(groups[:40], 30, 0)):
        assert (lambda c: sorted(np.concatenate(c)) == list(range(len(points))) and max(map(len, c)) <= learn.PAM_CELL)(learn._cells(points))
        d = lambda m: np.sqrt(((points[:, None] - points[m]) ** 2).sum(2)).min(1).sum()
        assert d(learn.pam_tiled(spark, points, 4)) == pytest.approx(d(learn.pam(points, 4)), rel=1e-9)
    few = np.repeat([[0.0, 0.0], [5.0, 5.0]], 50, 0)
    assert len(set(learn.pam_tiled(spark, few, 3))) == 3
