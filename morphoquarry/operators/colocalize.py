"""Objects of several channels that lie on or next to each other, as composite objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphoquarry.operators import runs as r
from morphoquarry.operators.neighbours import nearest_within

#: Fixed value: share of the base object beyond which an overlap counts.
THRESHOLD = 0.001


@dataclass(frozen=True)
class Composite:
    """Channels that must meet; the last is the base, whose objects the composite takes over under the id ``assign``."""

    channels: tuple[int, ...]
    assign: int

    @property
    def base(self) -> int:
        return self.channels[-1]

    @property
    def others(self) -> tuple[int, ...]:
        return self.channels[:-1]


def share_of_base(shared: Column, base: Column, parts: list[Column]) -> Column:
    """The other masks restricted to the base object: all of them over all of it."""
    return shared / base


def share_of_union(shared: Column, base: Column, parts: list[Column]) -> Column:
    """Two channels: shared over base and partner together. With more, over the sum of all less what is shared."""
    total = base
    for p in parts:
        total = total + p
    return shared / (total - shared * len(parts))


def overlap_colocalize(runs: DataFrame, composites: list[Composite], threshold: float = THRESHOLD, metric=share_of_base) -> DataFrame:
    """(ex, assign, base, partners, share) of base objects that overlap an object of every other channel, for runs (ex, id, c, row, lo, hi).

    ``partners`` maps a channel to its object that shares most pixels with the base; ties go to the smaller id. A
    composite counts if ``metric`` of the pixels where all meet lies above ``threshold``. Objects of a channel no
    composite names and of a NULL channel take no part. Without composites or runs the result is empty.
    """
    sizes = r.sizes(runs.drop("c")).select("ex", "id", "n")
    out = None
    for spec in composites:
        here = runs.where(F.col("c") == spec.base).drop("c")
        chosen = []
        for c in spec.others:
            other = runs.where(F.col("c") == c).drop("c")
            met = r.met(here, other)
            n = met.groupBy("ex", "id", "other").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
            # what is met first decides the partner over the whole base object, not over what is left of it
            if chosen:
                n = r.met(runs.where(F.col("c") == spec.base).drop("c"), other).groupBy("ex", "id", "other").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
            best = n.groupBy("ex", "id").agg(F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("other"))
            kept = [f"p{k}" for k in chosen]
            here = met.join(best, ["ex", "id", "other"], "left_semi").select("ex", "id", "row", "lo", "hi", *kept, F.col("other").alias(f"p{c}"))
            chosen.append(c)
        names = [f"p{c}" for c in chosen]
        shared = here.groupBy("ex", "id", *names).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("shared")).join(sizes, ["ex", "id"])
        for c in chosen:
            shared = shared.join(sizes.select("ex", F.col("id").alias(f"p{c}"), F.col("n").alias(f"n{c}")), ["ex", f"p{c}"])
        value = metric(F.col("shared"), F.col("n"), [F.col(f"n{c}") for c in chosen])
        partners = F.create_map(*[x for c in chosen for x in (F.lit(c), F.col(f"p{c}"))])
        part = shared.select("ex", F.lit(spec.assign).cast("long").alias("assign"), F.col("id").alias("base"), partners.alias("partners"), value.alias("share")).where(F.col("share") > threshold)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else runs.sparkSession.createDataFrame([], "ex string, assign long, base long, partners map<int,long>, share double")


def place_of(centroid: Column, bbox: Column) -> Column:
    """The centroid, or the middle of the box (all low ends, then all high ends) where there is none."""
    axes = (F.size(bbox) / 2).cast("int")
    middle = F.zip_with(F.slice(bbox, 1, axes), F.slice(bbox, axes + 1, axes), lambda a, b: (a + b).cast("double") / 2)
    return F.coalesce(centroid, F.when(F.size(bbox) > 1, middle))


def distance_colocalize(objects: DataFrame, composites: list[Composite], id_col: str, channel: str, coords: list[str], keys: list[str], threshold: float, pixel_size: float = 1.0) -> DataFrame:
    """(assign, base, partners, distances, mean_distance) of base objects with an object of every other channel nearer than ``threshold``.

    ``partners`` and ``distances`` map a channel to its nearest object with equal keys and how far it is; coordinates are
    multiplied by ``pixel_size`` first. Distances equal to the threshold don't count; ties go to the smaller id; an object
    may be the partner of many. Rows with NULL keys or coordinates have none.
    """
    scaled = objects.select(id_col, channel, *keys, *[(F.col(c) * pixel_size).alias(c) for c in coords])
    out = None
    for spec in composites:
        found = None
        for c in spec.others:
            near = nearest_within(scaled.where(F.col(channel) == spec.base), scaled.where(F.col(channel) == c), id_col, coords, keys, threshold).select(F.col("id").alias("base"), F.col("match").alias(f"p{c}"), F.col("distance").alias(f"d{c}"))
            found = near if found is None else found.join(near, "base")
        as_map = lambda p: F.create_map(*[x for c in spec.others for x in (F.lit(c), F.col(f"{p}{c}"))])
        total = sum((F.col(f"d{c}") for c in spec.others), F.lit(0.0))
        part = found.select(F.lit(spec.assign).cast("long").alias("assign"), "base", as_map("p").alias("partners"), as_map("d").alias("distances"), (total / len(spec.others)).alias("mean_distance"))
        out = part if out is None else out.unionAll(part)
    return out


def with_composites(objects: DataFrame, composites: DataFrame, id_col: str, channel: str) -> DataFrame:
    """The objects with ``share`` NULL, and behind them each composite: its base object's row under the composite's id, with its share."""
    own = objects.withColumn("share", F.lit(None).cast("double"))
    made = objects.join(composites.select(F.col("base").alias(id_col), "assign", "share"), id_col).withColumn(channel, F.col("assign").cast(objects.schema[channel].dataType)).drop("assign")
    return own.unionByName(made)
