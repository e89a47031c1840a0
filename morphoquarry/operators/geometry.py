"""Polygons as arrays of vertices: areas, boxes, clipping, rasters, outlines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def ring_area(ring: Column) -> Column:
    """Area by the shoelace rule, never negative; rings may be open or closed; fewer than three vertices have area 0."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def polygon_area(ring: Column, holes: Column) -> Column:
    """The ring's area without its holes', which are taken to lie inside and apart; NULL holes are none."""
    inner = F.aggregate(F.coalesce(F.transform(holes, ring_area), F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + v)
    return ring_area(ring) - inner


def box(ring: Column) -> list[Column]:
    """x_min, y_min, x_max, y_max."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def rings_from_vertices(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """(keys, ring) from rows of vertices, closed, without shapes of fewer than three places or area 0."""
    points = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    rings = df.groupBy(*keys).agg(points.alias("ring")).where(F.size(F.array_distinct("ring")) > 2)
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    return rings.withColumn("ring", closed).where(ring_area(F.col("ring")) > 0)


def area_in_box(df: DataFrame, ring: str, bounds: tuple[float, float, float, float], out: str) -> DataFrame:
    """Adds the area of the ring within a box (x0, y0, x1, y1); 0 where nothing is left, NULL for NULL rings.

    The area is the integral, along the outline, of its height cut to the box over the part of each edge above the box's
    base: of a straight edge the mean of the cut height has a closed form. Rings may be open or closed; vertices must not
    be NULL. Fewer than three vertices have area 0.
    """
    x0, y0, x1, y1 = map(float, bounds)
    points = F.col(ring)
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(1))), F.slice(points, 1, 1))
    cut = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), v))
    # the integral of the cut height over heights up to y
    height = lambda y: F.when(y < y0, y * y0).when(y > y1, y1 * y - (y1 * y1 - y0 * y0) / 2).otherwise((y * y + y0 * y0) / 2)

    def strip(a: Column, b: Column) -> Column:
        u, v = cut(a["x"], x0, x1), cut(b["x"], x0, x1)
        slope = F.coalesce(F.try_divide(b["y"] - a["y"], b["x"] - a["x"]), F.lit(0.0))
        p, q = a["y"] + (u - a["x"]) * slope, a["y"] + (v - a["x"]) * slope
        mean = F.when(F.abs(q - p) < 1e-9, cut(p, y0, y1)).otherwise((height(q) - height(p)) / (q - p))
        return (v - u) * mean

    total = F.aggregate(F.zip_with(points, following, strip), F.lit(0.0), lambda t, v: t + v)
    return df.withColumn(out, F.when(F.size(points) < 3, F.when(points.isNotNull(), 0.0)).otherwise(F.abs(total)))


def spans(df: DataFrame, keys: list[str], ring: str, pitch: float, holes: str | None = None) -> DataFrame:
    """(keys, row, lo, hi, h): runs of places of a square grid inside each ring by the even-odd rule, scan line by scan line, in the JVM; h has the runs (lo, hi) of its holes on the line.

    A place on a lower or left outline is inside, on an upper or right one outside. Crossings of a line are sorted and
    taken in pairs, so the work follows the runs, not the boxes. The keys must tell the rings apart.
    """
    rings = F.array(F.col(ring).cast(RING))
    if holes:
        rings = F.concat(rings, F.coalesce(F.col(holes).cast(f"array<{RING}>"), F.array().cast(f"array<{RING}>")))
    parts = df.where(F.size(ring) > 2).select(*keys, F.posexplode(rings).alias("part", "points")).where(F.size("points") > 2)
    points = F.col("points")
    closed = F.arrays_zip(points.alias("a"), F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(1))), F.slice(points, 1, 1)).alias("b"))
    edges = parts.select(*keys, "part", F.explode(closed).alias("e"))
    edges = edges.select(*keys, "part", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low / pitch).cast("long"), (F.ceil(high / pitch) - 1).cast("long")
    lines = edges.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("row"))
    y = F.col("row") * pitch
    crossings = lines.select(*keys, "part", "row", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("cx")).where("cx IS NOT NULL")
    sorted_x = crossings.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("part", "cx"))).alias("xs"))
    pair = f"struct(xs[2 * i].part AS part, CAST(ceil(xs[2 * i].cx / {pitch}D) AS BIGINT) AS lo, CAST(ceil(xs[2 * i + 1].cx / {pitch}D) - 1 AS BIGINT) AS hi)"
    pairs = F.expr(f"filter(transform(filter(sequence(0, size(xs) div 2 - 1), i -> i >= 0), i -> {pair}), s -> s.lo <= s.hi)")
    runs = sorted_x.select(*keys, "row", pairs.alias("p")).select(*keys, "row", F.filter("p", lambda s: s["part"] > 0).alias("h"), F.explode(F.filter("p", lambda s: s["part"] == 0)).alias("s"))
    return runs.select(*keys, "row", "s.lo", "s.hi", "h")


def in_hole(col: Column) -> Column:
    """Whether a column of a row of ``spans`` lies in a hole."""
    return F.exists("h", lambda s: (s["lo"] <= col) & (col <= s["hi"]))


def raster(df: DataFrame, keys: list[str], ring: str, pitch: float, holes: str | None = None) -> DataFrame:
    """(keys, y, x): the places of ``spans`` that are in no hole."""
    cols = F.sequence("lo", "hi")
    if holes:
        cols = F.when(F.size("h") == 0, cols).otherwise(F.filter(cols, lambda c: ~in_hole(c)))
    places = spans(df, keys, ring, pitch, holes).select(*keys, (F.col("row") * pitch).cast("double").alias("y"), F.explode(cols).alias("col"))
    return places.select(*keys, "y", (F.col("col") * pitch).cast("double").alias("x"))


def outlines(voxels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label, ring_no, ring): the outlines of labelled pixels (integer y, x) as closed rings along pixel edges.

    An edge is part of an outline if the pixel beyond it has another label. Edges are found by joins; only an object's
    outline, not its area, meets in one task.
    """
    pixels = voxels.select(*keys, F.col(label).alias("_l"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    sides = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(a).alias("ay"), F.lit(b).alias("ax"), F.lit(c).alias("by"), F.lit(e).alias("bx")) for dy, dx, a, b, c, e in ((-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0))])
    probes = pixels.select(*keys, "_l", "y", "x", F.explode(sides).alias("s"))
    beyond = pixels.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_l").alias("_l2"), F.col("y").alias("_y"), F.col("x").alias("_x"))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_l") == F.col("_l2"), F.col("y") + F.col("s.dy") == F.col("_y"), F.col("x") + F.col("s.dx") == F.col("_x")]
    edges = probes.join(beyond, on, "left_anti").select(*keys, "_l", (F.col("y") + F.col("s.ay")).alias("ay"), (F.col("x") + F.col("s.ax")).alias("ax"), (F.col("y") + F.col("s.by")).alias("by"), (F.col("x") + F.col("s.bx")).alias("bx"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voxels.schema if f.name in keys)

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for ay, ax, by, bx in pdf[["ay", "ax", "by", "bx"]].itertuples(index=False):
            after.setdefault((ay, ax), []).append((by, bx))
        rings = []
        for start in sorted(after):
            while after.get(start):
                at, ring, came = start, [start], None
                while True:
                    ways = after[at]
                    # where two corners touch, turn right so that the rings stay simple
                    turn = {w: 0 if came is None else (came[0] * (w[1] - at[1]) - came[1] * (w[0] - at[0])) for w in ways}
                    to = min(ways, key=lambda w: (turn[w], w))
                    ways.remove(to)
                    came, at = (to[0] - at[0], to[1] - at[1]), to
                    ring.append(at)
                    if at == start:
                        break
                corners = [p for i, p in enumerate(ring[:-1]) if (ring[i - 1 if i else -2][0] != p[0]) or (ring[i + 1][0] != p[0])]
                corners = [p for i, p in enumerate(corners) if not ((corners[i - 1][1] == p[1] == corners[(i + 1) % len(corners)][1]))]
                rings.append(corners + corners[:1])
        out = pd.DataFrame({"ring_no": range(len(rings)), "ring": [[{"x": float(x), "y": float(y)} for y, x in r] for r in rings]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out[label] = pdf["_l"].iloc[0]
        return out[[*keys, label, "ring_no", "ring"]]

    return edges.groupBy(*keys, "_l").applyInPandas(assemble, f"{kinds}, {label} long, ring_no int, ring {RING}")
