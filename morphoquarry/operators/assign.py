"""Regions of objects by named methods; each adds the columns roi_i_by… and roi_polyi_by… (and roi_distance)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphoquarry.operators import geometry as g
from morphoquarry.operators.neighbours import nearest_outlines
from morphoquarry.operators.proximity import containing_polygons
from morphoquarry.session import Cut


@dataclass(frozen=True)
class Regions:
    """Points (``id_col``, ``key``, x, y) and polygons (poly_id, ``key``, label, sub_idx, ring, holes) that share the column ``key``."""

    points: DataFrame
    polygons: DataFrame
    id_col: str
    key: str


def _inside(t: Regions) -> DataFrame:
    return containing_polygons(t.points, t.id_col, F.col("x"), F.col("y"), [F.col(t.key)], t.polygons, "poly_id", "ring", "holes", [F.col(t.key)])


def by_centroid(t: Regions) -> DataFrame:
    """The polygon that holds the point; of several the first by (label, sub_idx, poly_id)."""
    poly = t.polygons.select(F.col("poly_id").alias("poly"), "label", "sub_idx")
    first = _inside(t).join(poly, "poly").groupBy(F.col("id").alias(t.id_col)).agg(F.min(F.struct("label", "sub_idx", "poly")).alias("s"))
    return first.select(t.id_col, F.col("s.label").alias("roi"), F.col("s.poly").alias("poly"))


def by_masking(t: Regions) -> DataFrame:
    """The region at the pixel the point is rounded to (half to even); of several the smallest label, then poly_id."""
    at = t.points.select(t.id_col, t.key, F.rint("y").cast("long").alias("row"), F.rint("x").cast("long").alias("col"))
    runs = g.spans(t.polygons, [t.key, "poly_id", "label"], "ring", 1.0, "holes")
    met = at.join(runs.hint("merge"), [t.key, "row"]).where((F.col("lo") <= F.col("col")) & (F.col("col") <= F.col("hi")) & ~g.in_hole(F.col("col")))
    return met.groupBy(t.id_col).agg(F.min(F.struct("label", "poly_id")).alias("s")).select(t.id_col, F.col("s.label").alias("roi"), F.col("s.poly_id").alias("poly"))


def by_distance(t: Regions) -> DataFrame:
    """The nearest polygon and how far it is: 0 inside, else the distance to its outline; ties go to the smaller poly_id."""
    out = nearest_outlines(t.points, t.id_col, F.col("x"), F.col("y"), t.key, t.polygons, "poly_id", "ring", "holes", Cut(t.points.sparkSession))
    every = out.unionAll(_inside(t).select("id", "poly", F.lit(0.0).alias("distance")))
    best = every.groupBy(F.col("id").alias(t.id_col)).agg(F.min(F.struct("distance", "poly")).alias("s"))
    labels = t.polygons.select(F.col("poly_id").alias("poly"), F.col("label").alias("roi"))
    return best.select(t.id_col, "s.poly", "s.distance").join(labels, "poly").select(t.id_col, "roi", "poly", "distance")


METHODS = {"Centroid": by_centroid, "Masking": by_masking, "Distance": by_distance}


def assign_regions(t: Regions, methods: list[str]) -> DataFrame:
    """The points with roi_i_by{Method} (0 without a region) and roi_polyi_by{Method} (−1), and roi_distance (NULL) of the method Distance.

    Polygons must hold each poly_id once. An unknown method raises KeyError before anything runs.
    """
    if unknown := [m for m in methods if m not in METHODS]:
        raise KeyError(f"no such methods: {unknown}; there are {sorted(METHODS)}")
    out = t.points
    for m in methods:
        got = METHODS[m](t)
        got = got.select(t.id_col, F.col("roi").alias(f"roi_i_by{m}"), F.col("poly").alias(f"roi_polyi_by{m}"), *([F.col("distance").alias("roi_distance")] if "distance" in got.columns else []))
        out = out.join(got, t.id_col, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(-1 if "poly" in c else 0)) for m in methods for c in (f"roi_i_by{m}", f"roi_polyi_by{m}")})
