"""Objects as runs of pixels along lines, compared without making their pixels.

Runs are rows (ex, id, row, lo, hi): columns lo to hi of a line, none of an object twice. Every object is compared with
all others of its example.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphoquarry.operators import geometry as g
from morphoquarry.session import Cut

#: Spark takes exploded rows for few and would broadcast them.
MERGE = "merge"


def solid(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, lo, hi): the rows of ``geometry.spans`` parted at their holes."""
    starts = F.array_distinct(F.filter(F.concat(F.array("lo"), F.transform("h", lambda s: s["hi"] + 1)), lambda c: (c >= F.col("lo")) & (c <= F.col("hi")) & ~g.in_hole(c)))
    end = lambda c: F.array_min(F.concat(F.array("hi"), F.transform(F.filter("h", lambda s: s["lo"] > c), lambda s: s["lo"] - 1)))
    return spans.select(*keys, "row", F.explode(F.transform(starts, lambda c: F.struct(c.alias("lo"), end(c).alias("hi")))).alias("s")).select(*keys, "row", "s.lo", "s.hi")


def sizes(runs: DataFrame) -> DataFrame:
    """(ex, id, n, cy, cx): pixels and centre of each object."""
    n = F.col("hi") - F.col("lo") + 1
    sums = runs.groupBy("ex", "id").agg(F.sum(n).alias("n"), F.sum(n * F.col("row")).alias("y"), F.sum(n * (F.col("lo") + F.col("hi"))).alias("x"))
    return sums.select("ex", "id", "n", (F.col("y") / F.col("n")).alias("cy"), (F.col("x") / (2 * F.col("n"))).alias("cx"))


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """(columns of a, other, columns of b but its id, lo, hi): the runs that objects of a share with other objects of b, on the same line."""
    right = b.withColumnsRenamed({"id": "other", "lo": "_lo", "hi": "_hi"})
    both = a.join(right.hint(MERGE), ["ex", "row"]).where("id <> other AND lo <= _hi AND _lo <= hi")
    return both.withColumns({"lo": F.greatest("lo", "_lo"), "hi": F.least("hi", "_hi")}).drop("_lo", "_hi")


def shared(runs: DataFrame) -> DataFrame:
    """(ex, id, other, shared) of overlapping objects, each pair both ways."""
    return met(runs, runs).groupBy("ex", "id", "other").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("shared"))


def first_hits(runs: DataFrame) -> DataFrame:
    """(ex, id, other): the object met first going outwards from an object's centre over its pixels; ties go to the smaller id."""
    hits = met(runs, runs).join(sizes(runs), ["ex", "id"])
    x = F.greatest("lo", F.least("hi", F.floor(F.col("cx") + 0.5)))
    d2 = F.round((F.col("row") - F.col("cy")) * (F.col("row") - F.col("cy")) + (x - F.col("cx")) * (x - F.col("cx")), 6)
    return hits.groupBy("ex", "id").agg(F.min_by("other", F.struct(d2, F.col("other"))).alias("other"))


def triple_shares(runs: DataFrame) -> DataFrame:
    """(ex, id, first, second, share): of each pair of other populations (column c, none NULL) the objects that share most with an object, and the share of it where all three meet."""
    pairs = met(runs, runs.withColumnRenamed("c", "oc")).where("c <> oc")
    best = pairs.groupBy("ex", "id", "oc", "other").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).groupBy("ex", "id", "oc").agg(F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("other"))
    chosen = pairs.select("ex", "id", "row", "lo", "hi", "oc", "other").join(best, ["ex", "id", "oc", "other"], "left_semi")
    second = chosen.select("ex", "id", "row", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("oc").alias("oc2"), F.col("other").alias("second"))
    here = chosen.join(second.hint(MERGE), ["ex", "id", "row"]).where("oc < oc2 AND lo <= _hi AND _lo <= hi")
    n = here.groupBy("ex", "id", F.col("other").alias("first"), "second").agg(F.sum(F.least("hi", "_hi") - F.greatest("lo", "_lo") + 1).alias("shared"))
    return n.join(sizes(runs), ["ex", "id"]).select("ex", "id", "first", "second", (F.col("shared") / F.col("n")).alias("share"))


def properties(runs: DataFrame) -> DataFrame:
    """(ex, id, area, centroid and box, axes, orientation, …) of each object, from sums over its runs.

    Axes are those of the ellipse with the same second moments, each pixel a unit square; orientation is the angle of the
    long axis to the line direction's normal, in (−π/2, π/2]; extent is the area's share of the box.
    """
    lo, hi, row = (F.col(c).cast("double") for c in ("lo", "hi", "row"))
    n = hi - lo + 1
    square = lambda k: k * (k + 1) * (2 * k + 1) / 6
    sums = {"n": n, "y": n * row, "x": n * (lo + hi) / 2, "yy": n * row * row, "xx": square(hi) - square(lo - 1), "xy": row * n * (lo + hi) / 2}
    t = runs.groupBy("ex", "id").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()], F.min("row").alias("y0"), F.min("lo").alias("x0"), (F.max("row") + 1).alias("y1"), (F.max("hi") + 1).alias("x1"))
    cy, cx = F.col("_y") / F.col("_n"), F.col("_x") / F.col("_n")
    t = t.withColumns({"cy": cy, "cx": cx, "_a": F.col("_yy") / F.col("_n") - cy * cy + 1 / 12, "_b": F.col("_xx") / F.col("_n") - cx * cx + 1 / 12, "_c": F.col("_xy") / F.col("_n") - cy * cx})
    root = F.sqrt((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b")) / 4 + F.col("_c") * F.col("_c"))
    middle = (F.col("_a") + F.col("_b")) / 2
    t = t.withColumns({"axis_major_length": 4 * F.sqrt(middle + root), "axis_minor_length": 4 * F.sqrt(F.greatest(middle - root, F.lit(0.0)))})
    return t.select("ex", "id", F.col("_n").cast("long").alias("area"), "cy", "cx", "y0", "x0", "y1", "x1", "axis_major_length", "axis_minor_length",
                    F.try_divide("axis_major_length", "axis_minor_length").alias("aspect"), (F.atan2(2 * F.col("_c"), F.col("_a") - F.col("_b")) / 2).alias("orientation"),
                    (F.col("_n") / ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))).alias("extent"), F.sqrt(4 * F.col("_n") / F.lit(math.pi)).alias("equivalent_diameter"))


def perimeters(runs: DataFrame) -> DataFrame:
    """(ex, id, perimeter): the length of the pixel edges between an object and what is not it, holes' included.

    Each run has two ends, unless another run follows at once; the edges above and below are its pixels less those met by
    the object's runs of the next line.
    """
    n = F.col("hi") - F.col("lo") + 1
    follows = F.coalesce((F.lead("lo").over(Window.partitionBy("ex", "id", "row").orderBy("lo")) == F.col("hi") + 1).cast("int"), F.lit(0))
    own = runs.withColumn("follows", follows).groupBy("ex", "id").agg(F.sum(2 * n + 2 - 2 * F.col("follows")).alias("edges"))
    below = runs.select("ex", "id", (F.col("row") - 1).alias("row"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    both = runs.join(below.hint(MERGE), ["ex", "id", "row"]).where("lo <= _hi AND _lo <= hi")
    inner = both.groupBy("ex", "id").agg(F.sum(2 * (F.least("hi", "_hi") - F.greatest("lo", "_lo") + 1)).alias("inner"))
    return own.join(inner, ["ex", "id"], "left").select("ex", "id", (F.col("edges") - F.coalesce("inner", F.lit(0))).cast("double").alias("perimeter"))


def _near(left: DataFrame, runs: DataFrame, radius: int) -> DataFrame:
    """(ex, id, other, d2): for objects of ``left`` those others by the least distance between pixels that lie within the radius.

    Only objects whose boxes come that near are compared, and of them only runs near the other's box.
    """
    ends = [F.min("row").alias("y0"), F.max("row").alias("y1"), F.min("lo").alias("x0"), F.max("hi").alias("x1")]
    box, other = left.groupBy("ex", "id").agg(*ends), runs.groupBy("ex", "id").agg(*ends).withColumnsRenamed({"id": "other", **{c: f"_{c}" for c in ("y0", "y1", "x0", "x1")}})
    near = " AND ".join(f"{a}{c}0 <= {b}{c}1 + {radius}" for c in "yx" for a, b in (("", "_"), ("_", "")))
    pairs = box.join(other, "ex").where(f"id <> other AND {near}")
    line = F.floor(F.col("row") / (radius + 1))
    one = left.join(pairs.select("ex", "id", "other", "_y0", "_y1", "_x0", "_x1").hint(MERGE), ["ex", "id"])
    one = one.where(f"row BETWEEN _y0 - {radius} AND _y1 + {radius} AND lo <= _x1 + {radius} AND hi >= _x0 - {radius}")
    one = one.select("ex", "id", "other", "row", "lo", "hi", F.explode(F.array(line - 1, line, line + 1)).alias("b"))
    two = runs.withColumnRenamed("id", "other").join(pairs.select("ex", "id", "other", "y0", "y1", "x0", "x1").hint(MERGE), ["ex", "other"])
    two = two.where(f"row BETWEEN y0 - {radius} AND y1 + {radius} AND lo <= x1 + {radius} AND hi >= x0 - {radius}")
    two = two.select("ex", "id", "other", line.alias("b"), F.col("row").alias("_row"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    dy, dx = F.col("row") - F.col("_row"), F.greatest(F.lit(0), F.col("lo") - F.col("_hi"), F.col("_lo") - F.col("hi"))
    return one.join(two.hint(MERGE), ["ex", "id", "other", "b"]).withColumn("d2", dy * dy + dx * dx).where(F.col("d2") <= radius * radius).groupBy("ex", "id", "other").agg(F.min("d2").alias("d2"))


def nearest(runs: DataFrame, cut: Cut, first: int = 16) -> DataFrame:
    """(ex, id, other, d): the nearest other object of the example by the least distance between pixels; ties go to the smaller id.

    Objects without one within ``first`` pixels are looked at again with four times the radius, until all that have
    another object in their example are done, however far away it lies.
    """
    radius, out = first, None
    alone = runs.groupBy("ex").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a = b").select("ex")
    left = runs.join(alone, "ex", "left_anti")
    while True:
        found = _near(left, runs, radius).groupBy("ex", "id").agg(F.min(F.struct("d2", "other")).alias("s")).select("ex", "id", "s.other", F.sqrt("s.d2").alias("d"))
        found = cut.table(found)
        out = found if out is None else out.unionAll(found)
        left = cut.table(left.join(found, ["ex", "id"], "left_anti"))
        if not left.limit(1).count():
            return out
        radius *= 4
