"""Small helpers on NULLs and empty input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphoquarry.functions import normalise
from morphoquarry.operators import filters, learn, morphology, sets


def test_columns_and_rows_by_value(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (3, "a", 4.0)], "n int, t string, v double")
    assert filters.numeric_columns(df) == ["n", "v"]
    assert [r.n for r in filters.pick(df, t="a").sort("n").collect()] == [1, 3] and [tuple(r) for r in filters.pick(df, "n", t=None).collect()] == [(2,)]
    assert filters.pick(df.limit(0), "v", n=1).count() == 0


def test_sets_of_conditions(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "n int")
    kept = df.where(sets.subtract([F.col("n") > 1, F.col("n") == 0], [F.col("n") == 3])).collect()
    assert sorted(r.n for r in kept) == [0, 2, 4, 5] and df.where(sets.subtract([], [])).count() == 0


def test_tiles_and_grey(spark):
    df = spark.createDataFrame([(0, 0), (63, 64), (-1, 128)], "y long, x long")
    assert [(r.tile_y, r.tile_x) for r in morphology.tiles(df, ["y", "x"], 64).collect()] == [(0, 0), (0, 1), (-1, 2)]
    rgb = spark.createDataFrame([(1.0, 1.0, 1.0), (None, 1.0, 1.0)], "r double, g double, b double")
    got = [x.v for x in rgb.select(normalise.grey(F.col("r"), F.col("g"), F.col("b")).alias("v")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] is None


def test_centres_back_in_feature_space():
    turn = np.array([[0.6, 0.8], [-0.8, 0.6]])
    features = np.array([[1.0, 2.0], [3.0, -1.0]])
    back = learn.describe_components(turn, ["p", "q"], features @ turn.T)
    assert list(back.columns) == ["p", "q"] and np.allclose(back.to_numpy(), features)
