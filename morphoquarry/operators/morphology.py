"""Operators on labelled places (integer y, x, and z if given) as set operations, thresholds, and growth from seeds."""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphoquarry.operators.graph import connected_components


def offsets(axes: int, reach: int = 1, connectivity: int = 1) -> list[tuple[int, ...]]:
    """Steps of at most ``connectivity`` axes at a time (1: 4 or 6 neighbours, 2: 8 or 18, 3: 26); over 1, steps within a ball of radius ``reach``."""
    if reach > 1:
        return [o for o in product(range(-reach, reach + 1), repeat=axes) if any(o) and sum(v * v for v in o) <= reach * reach]
    return [o for o in product((-1, 0, 1), repeat=axes) if 0 < sum(map(abs, o)) <= connectivity]


def _moved(df: DataFrame, keep: list[str], axes: list[str], steps: list[tuple[int, ...]]) -> DataFrame:
    ways = F.array(*[F.struct(*[F.lit(v).cast("long").alias(a) for a, v in zip(axes, o)]) for o in steps])
    return df.select(*keep, *axes, F.explode(ways).alias("_o")).select(*keep, *[(F.col(a) + F.col(f"_o.{a}")).alias(a) for a in axes])


def dilate(voxels: DataFrame, keys: list[str], axes: list[str], label: str, reach: int = 1, connectivity: int = 1) -> DataFrame:
    """Labels grown into empty places; where several reach one, the smallest gets it. Labelled places stay as they are."""
    grown = _moved(voxels, [*keys, label], axes, offsets(len(axes), reach, connectivity)).groupBy(*keys, *axes).agg(F.min(label).alias(label))
    new = grown.join(voxels.select(*keys, *axes), [*keys, *axes], "left_anti")
    return voxels.select(*keys, *axes, label).distinct().unionByName(new.select(*keys, *axes, label))


def erode(voxels: DataFrame, keys: list[str], axes: list[str], label: str, connectivity: int = 1) -> DataFrame:
    """Places all of whose neighbours have the same label."""
    steps = offsets(len(axes), 1, connectivity)
    v = voxels.select(*keys, *axes, label).distinct()
    met = _moved(v, [*keys, label], axes, steps).join(v, [*keys, *axes, label]).groupBy(*keys, *axes, label).agg(F.count(F.lit(1)).alias("_n"))
    return met.where(F.col("_n") == len(steps)).drop("_n")


def outline_places(voxels: DataFrame, keys: list[str], axes: list[str], label: str, connectivity: int = 1) -> DataFrame:
    """Places with a neighbour of another label or none."""
    v = voxels.select(*keys, *axes, label).distinct()
    return v.join(erode(v, keys, axes, label, connectivity), [*keys, *axes, label], "left_anti")


def shrink(voxels: DataFrame, keys: list[str], axes: list[str], label: str, least: int = 1) -> DataFrame:
    """Eroded labels; an object that would keep fewer than ``least`` places stays whole."""
    v = voxels.select(*keys, *axes, label).distinct()
    small = erode(v, keys, axes, label)
    enough = small.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*keys, label)
    return small.join(enough, [*keys, label], "left_semi").unionByName(v.join(enough, [*keys, label], "left_anti"))


def part_labels(voxels: DataFrame, keys: list[str], axes: list[str], label: str, connectivity: int = 1, out: str = "part") -> DataFrame:
    """Adds the number of the connected part of a label that a place belongs to: a 64-bit hash of one of its places."""
    v = voxels.select(*keys, *axes, label).distinct().withColumn("_id", F.xxhash64(*keys, *axes, label))
    forward = [o for o in offsets(len(axes), 1, connectivity) if o > tuple([0] * len(axes))]
    links = _moved(v, [*keys, label, "_id"], axes, forward).join(v.withColumnRenamed("_id", "_to"), [*keys, *axes, label]).select(F.col("_id").alias("src"), F.col("_to").alias("dst"))
    parts = connected_components(links, v.select(F.col("_id").alias("id")))
    return v.join(parts.select(F.col("id").alias("_id"), F.col("component").alias(out)), "_id").drop("_id")


def propagate(voxels: DataFrame, keys: list[str], label: str, out: str = "object") -> DataFrame:
    """Adds one number for labels of successive slices z that overlap in y and x: the smallest (z, label) code of the chain's links."""
    v = voxels.select(*keys, "z", "y", "x", label).distinct().withColumn("_id", F.xxhash64(*keys, "z", label))
    nxt = v.select(*keys, (F.col("z") - 1).alias("z"), "y", "x", F.col("_id").alias("dst"))
    links = v.join(nxt, [*keys, "z", "y", "x"]).select(F.col("_id").alias("src"), "dst").distinct()
    parts = connected_components(links, v.select(F.col("_id").alias("id")).distinct())
    return v.join(parts.select(F.col("id").alias("_id"), F.col("component").alias(out)), "_id").drop("_id")


def otsu(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, threshold): the upper end of the bin that parts the histogram with the greatest variance between its sides; the first wins.

    A constant group has its value as threshold. Values are binned between the group's ends, so only ``bins`` rows per
    group meet.
    """
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    binned = df.where(F.col(value).isNotNull()).join(ends, keys).withColumn("_b", F.least(F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("_lo")) * bins, width), F.lit(0.0))), F.lit(bins - 1)))
    counts = binned.groupBy(*keys, "_lo", "_hi", "_b").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = counts.withColumns({"_w": F.sum("_n").over(upto), "_s": F.sum(F.col("_n") * F.col("_b")).over(upto), "_wt": F.sum("_n").over(w), "_st": F.sum(F.col("_n") * F.col("_b")).over(w)})
    gap = F.try_divide("_s", "_w") - F.try_divide(F.col("_st") - F.col("_s"), F.col("_wt") - F.col("_w"))
    s = s.withColumn("_v", F.coalesce(F.col("_w") * (F.col("_wt") - F.col("_w")) * gap * gap, F.lit(-1.0)))
    best = s.groupBy(*keys).agg(F.min_by(F.struct("_b", "_lo", "_hi"), F.struct(-F.col("_v"), F.col("_b"))).alias("m"))
    return best.select(*keys, F.when(F.col("m._hi") == F.col("m._lo"), F.col("m._lo")).otherwise(F.col("m._lo") + (F.col("m._b") + 1) * (F.col("m._hi") - F.col("m._lo")) / bins).alias("threshold"))


def downsample(df: DataFrame, keys: list[str], axes: list[str], value: str, factor: int) -> DataFrame:
    """Mean per block of ``factor`` places along each axis."""
    return df.groupBy(*keys, *[F.floor(F.col(a) / factor).alias(a) for a in axes]).agg(F.avg(value).alias(value))


def tiles(df: DataFrame, axes: list[str], size: int) -> DataFrame:
    return df.withColumns({f"tile_{a}": F.floor(F.col(a) / size) for a in axes})


def flood(df: DataFrame, keys: list[str], axes: list[str], value: str, seed: str, connectivity: int = 1) -> DataFrame:
    """Watershed from seeds: places join the seed from which they are reached over the lowest ridge, in order of value, then of the place.

    ``seed`` is a label or NULL. One image per key is held in one task; images are bounded by the instrument.
    """
    steps = offsets(len(axes), 1, connectivity)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in [*keys, *axes])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        height = {tuple(int(v) for v in r[:-1]): r[-1] for r in pdf[[*axes, value]].itertuples(index=False)}
        label = {tuple(int(v) for v in r[:-1]): int(r[-1]) for r in pdf[[*axes, seed]].dropna().itertuples(index=False)}
        queue = [(height[p], p) for p in sorted(label)]
        heapq.heapify(queue)
        while queue:
            level, at = heapq.heappop(queue)
            for o in steps:
                to = tuple(a + b for a, b in zip(at, o))
                if to in height and to not in label:
                    label[to] = label[at]
                    heapq.heappush(queue, (max(level, height[to]), to))
        out = pd.DataFrame([(*p, v) for p, v in label.items()], columns=[*axes, "basin"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, *axes, "basin"]]

    return df.select(*keys, *axes, value, seed).groupBy(*keys).applyInPandas(run, f"{kinds}, basin long")


def skeleton_length(voxels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label, length) of the longest way along each object's skeleton (2-D), steps of 1 or √2.

    Ways are shortest ones, from any end of the skeleton to any place; in parts without an end, as loops are, from any
    place. An object without places has no row.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voxels.schema if f.name in [*keys, label])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places = thinned({(int(y), int(x)) for y, x in pdf[["y", "x"]].itertuples(index=False)})
        out = pdf[[*keys, label]].iloc[:1].reset_index(drop=True)
        return out.assign(length=longest_way(places))

    return voxels.groupBy(*keys, label).applyInPandas(run, f"{kinds}, length double")


def thinned(places: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Thinning by peeling outline places that no connection depends on, from two sides in turn."""
    if not places:
        return set()
    y0, x0 = min(y for y, _ in places) - 1, min(x for _, x in places) - 1
    grid = np.zeros((max(y for y, _ in places) - y0 + 2, max(x for _, x in places) - x0 + 2), bool)
    grid[tuple(np.array(sorted(places)).T - [[y0], [x0]])] = True
    return {(y + y0, x + x0) for y, x in thinned_grid(grid)}


def thinned_grid(grid: np.ndarray) -> set[tuple[int, int]]:
    """``thinned`` for a grid with an empty margin. The whole grid is one number of a bit a place, so that neighbours are shifts of it."""
    height, width = grid.shape
    out = int.from_bytes(np.packbits(grid.ravel(), bitorder="little").tobytes(), "little")
    while True:
        before = out
        for side in (0, 1):
            up, down, left, right = out << width, out >> width, out << 1, out >> 1
            n = (up, up >> 1, right, down >> 1, down, down << 1, left, up << 1)
            # turns: some, several; two or more in a row that are set; none in a row that are both empty
            some = several = two = 0
            full, a = out, n[7]
            for b in n:
                turn = (a ^ b) & b
                several |= some & turn
                some |= turn
                two |= a & b
                full &= a | b
                a = b
            shut = (up & right & down) | (right & down & left) if side == 0 else (up & right & left) | (up & down & left)
            gone = out & some & two
            out ^= gone & ~(several | full | shut)
        if out == before:
            bits = np.unpackbits(np.frombuffer(out.to_bytes((height * width + 7) // 8, "little"), np.uint8), bitorder="little")
            y, x = np.divmod(np.flatnonzero(bits), width)
            return set(zip(y.tolist(), x.tolist()))


def flooded_from(at: np.ndarray, level: np.ndarray, seeds: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which seed each place of a grid of ``size`` places, rows of ``width``, is reached from; -1 for none. ``at`` are the places that exist, with a free place to all sides, and their levels from 0."""
    height, basin = np.full(size, -1), np.full(size, -1)
    height[at], basin[seeds] = level, np.arange(len(seeds))
    queue = sorted((height[seeds] * size + seeds).tolist())
    height[seeds] = -1
    height, basin, push, pop = height.tolist(), basin.tolist(), heapq.heappush, heapq.heappop
    while queue:
        key = pop(queue)
        here = key % size
        base = key - here
        mine = basin[here]
        for to in (here - width, here - 1, here + 1, here + width):
            h = height[to]
            if h >= 0:
                height[to] = -1
                basin[to] = mine
                h *= size
                push(queue, (h if h > base else base) + to)
    return np.array(basin)


def longest_way(places: set[tuple[int, int]]) -> float:
    links = {p: [((p[0] + dy, p[1] + dx), (1.0 if not dy or not dx else 2**0.5)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (p[0] + dy, p[1] + dx) in places] for p in places}
    starts, seen, best = [], set(), 0.0
    for p in links:
        if p not in seen:
            part, todo = [], [p]
            seen.add(p)
            while todo:
                part.append(todo.pop())
                fresh = [q for q, _ in links[part[-1]] if q not in seen]
                seen.update(fresh)
                todo += fresh
            ends = [q for q in part if len(links[q]) <= 1]
            starts += ends
            if not ends:
                best = max(best, _widest(part, links))
    for start in starts:
        far, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            d, at = heapq.heappop(queue)
            if d > far[at]:
                continue
            for to, step in links[at]:
                if d + step < far.get(to, float("inf")):
                    far[to] = d + step
                    heapq.heappush(queue, (d + step, to))
        best = max(best, max(far.values(), default=0.0))
    return best


def _widest(part: list, links: dict) -> float:
    """The longest of the shortest ways between any two places of a part without ends, by way of its junctions: ways between those, and each place's two ways to them."""
    junctions = [p for p in part if len(links[p]) != 2] or part[:1]
    number = {p: i for i, p in enumerate(junctions)}
    ways = np.full((len(junctions), len(junctions)), np.inf)
    np.fill_diagonal(ways, 0.0)
    # (one junction, way to it, the other, way to it, which chain)
    rows, seen = [(i, 0.0, i, 0.0, -1 - i) for i in range(len(junctions))], set()
    chains = 0
    for p in junctions:
        for q, step in links[p]:
            if q in seen:
                continue
            before, at, chain, length = p, q, [], step
            while at not in number:
                seen.add(at)
                chain.append(length)
                to, step = next((t, s) for t, s in links[at] if t != before)
                before, at, length = at, to, length + step
            i, j = number[p], number[at]
            ways[i, j] = ways[j, i] = min(ways[i, j], length)
            rows += [(i, a, j, length - a, chains) for a in chain]
            chains += 1
    for k in range(len(junctions)):
        ways = np.minimum(ways, ways[:, k, None] + ways[None, k])
    u, a, v, b, chain = (np.array(c) for c in zip(*rows))
    best, block = 0.0, max(1, 1_000_000 // len(u))
    for i in range(0, len(u), block):
        s = slice(i, i + block)
        far = np.where(chain[s, None] == chain, np.abs(a[s, None] - a), np.inf)
        for w, c in ((u, a), (v, b)):
            for x, d in ((u, a), (v, b)):
                far = np.minimum(far, c[s, None] + ways[w[s, None], x] + d)
        best = max(best, float(far.max()))
    return best
