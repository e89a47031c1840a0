"""Medoids and importances over whole samples."""

import inspect

import numpy as np

from morphoquarry.operators import learn


def test_tiled_medoids_are_those_of_all_distances(spark, monkeypatch):
    monkeypatch.setattr(learn, "PAM_TILE", 5_000)
    rng = np.random.default_rng(2)
    for k in (1, 4):
        points = rng.normal(size=(300, 3)) + 6 * rng.integers(0, 2, (300, 3))
        assert learn.pam_tiled(spark, points, k).tolist() == learn.pam(points, k).tolist()


def test_clara_fits_on_more_rows_than_distances_are_held(spark):
    x = np.random.default_rng(3).normal(size=(2600, 2)).round(6)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double")
    centres = learn.clara(df, ["a", "b"], 3, "id", repeats=1)[1]
    assert sorted(map(tuple, centres)) == sorted(map(tuple, x[learn.pam(x, 3)]))


def test_defaults_of_the_reference():
    assert (learn.CLARA_SAMPLE, learn.CLARA_REPEATS) == (100_000, 5)
    given = inspect.signature(learn.permutation_importance).parameters
    assert (given["trees"].default, given["shuffles"].default) == (400, 15)
