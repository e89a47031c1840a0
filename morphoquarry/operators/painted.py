"""Polygons painted on images and held as runs of places, an image whole in one task.

Polygons are moved once, by image; all else happens where they are. Runs of many images lie one behind the other on a
single line, row after row with a margin, so that neighbours to the left and right are one place and those above and
below one row's length away, and set operations on places are operations on sorted intervals. Places are made only by
what returns them, in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from morphoquarry.operators import morphology
from morphoquarry.operators.geometry import RING
from morphoquarry.session import partitions

#: Stands for a NULL number; greater than all others, so that the smallest number at a place is never it unless alone.
NONE = np.iinfo(np.int64).max
#: Crossings of outlines and scan lines that are held at once (of one image, all), and rows of a batch returned.
CROSSINGS, BATCH = 200_000, 50_000
#: Tasks for each partition of a shuffle: polygons are small, but not the work on their places.
SPREAD = 4


class Line(NamedTuple):
    """Where the rows of planes (images, or one object's part of an image) lie on the line."""

    stride: int
    x0: int
    base: np.ndarray
    top: np.ndarray

    @classmethod
    def of(cls, plane: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, planes: int, margin: int = 2) -> Line:
        top, bottom = np.full(planes, NONE), np.full(planes, -NONE)
        np.minimum.at(top, plane, row)
        np.maximum.at(bottom, plane, row)
        used = top <= bottom
        top, bottom = np.where(used, top, 0) - margin, np.where(used, bottom, 0) + margin
        x0 = int(lo.min()) - margin if len(lo) else 0
        return cls(int(hi.max()) - x0 + 1 + margin if len(hi) else 1, x0, np.cumsum(bottom - top + 1) - (bottom - top + 1), top)

    def at(self, plane: np.ndarray, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (self.base[plane] + row - self.top[plane]) * self.stride + (x - self.x0)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(plane, row, column)."""
        line, x = np.divmod(at, self.stride)
        plane = np.searchsorted(self.base, line, "right") - 1
        return plane, line - self.base[plane] + self.top[plane], x + self.x0


class Painted(NamedTuple):
    """Disjoint runs ``lo`` to ``hi`` with a number each, ascending on the line; touching runs have different numbers."""

    line: Line
    lo: np.ndarray
    hi: np.ndarray
    id: np.ndarray

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(plane, row, first column, last column) of each run."""
        plane, row, lo = self.line.place(self.lo)
        return plane, row, lo, lo + (self.hi - self.lo)

    def where(self, keep: np.ndarray) -> Painted:
        return Painted(self.line, self.lo[keep], self.hi[keep], self.id[keep])


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: each index as often as it counts, and the numbers from 0 within it."""
    index = np.repeat(np.arange(len(n)), n)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)


def least(line: Line, lo: np.ndarray, hi: np.ndarray, number: np.ndarray) -> Painted:
    """Runs that may overlap, painted so that the smallest number holds a place."""
    ends = np.unique(np.concatenate([lo, hi + 1]))
    first = np.searchsorted(ends, lo)
    run, step = spread(np.searchsorted(ends, hi + 1) - first)
    piece = first[run] + step
    held, covered = np.full(len(ends), NONE), np.zeros(len(ends), bool)
    np.minimum.at(held, piece, number[run])
    covered[piece] = True
    new, last = covered.copy(), covered.copy()
    same = covered[1:] & covered[:-1] & (held[1:] == held[:-1])
    new[1:] &= ~same
    last[:-1] &= ~same
    return Painted(line, ends[new], ends[np.flatnonzero(last) + 1] - 1, held[new])


def met(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index in a, index in b, lo, hi) where runs of a meet those of b; b is disjoint and ascends."""
    first = np.searchsorted(bhi, alo, "left")
    i, step = spread(np.maximum(np.searchsorted(blo, ahi, "right") - first, 0))
    j = first[i] + step
    return i, j, np.maximum(alo[i], blo[j]), np.minimum(ahi[i], bhi[j])


def without(a: Painted, blo: np.ndarray, bhi: np.ndarray) -> Painted:
    """What of the runs lies outside others, which are disjoint and ascend."""
    _, _, lo, hi = met(a.lo, a.hi, blo, bhi)
    starts, ends = np.sort(np.concatenate([a.lo, hi + 1])), np.sort(np.concatenate([lo - 1, a.hi]))
    keep = starts <= ends
    starts, ends = starts[keep], ends[keep]
    return Painted(a.line, starts, ends, a.id[np.searchsorted(a.lo, starts, "right") - 1])


def joined(*parts: Painted) -> Painted:
    return Painted(parts[0].line, *[np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)])


def dilated(p: Painted, nameless: np.ndarray) -> Painted:
    """``p`` grown by one place up, down, left and right into empty places, as ``morphology.dilate``. In nameless planes nothing counts as taken, as SQL has it for NULL keys."""
    grown = least(p.line, *[np.concatenate(v) for v in zip(*[(p.lo + s, p.hi + s, p.id) for s in (-p.line.stride, -1, 1, p.line.stride)])]) if len(p.lo) else p
    taken = ~nameless[p.places()[0]]
    return joined(p, without(grown, p.lo[taken], p.hi[taken]))


def eroded(p: Painted, nameless: np.ndarray) -> Painted:
    """Places whose four neighbours have the same number; NULLs are not the same."""
    a = p.where((p.hi - p.lo > 1) & (p.id != NONE) & ~nameless[p.places()[0]])
    a = a._replace(lo=a.lo + 1, hi=a.hi - 1)
    for step in (-p.line.stride, p.line.stride):
        i, j, lo, hi = met(a.lo, a.hi, p.lo + step, p.hi + step)
        same = a.id[i] == p.id[j]
        a = Painted(p.line, lo[same], hi[same], a.id[i[same]])
    return a


def outlined(p: Painted, nameless: np.ndarray) -> Painted:
    inner = eroded(p, nameless)
    return without(p, inner.lo, inner.hi)


def shrunk(p: Painted, nameless: np.ndarray, fewest: int) -> Painted:
    """Eroded, but objects whole of which fewer than ``fewest`` places would be left."""
    inner = eroded(p, nameless)
    plane, row, lo, hi = inner.places()
    code, which = np.unique(np.stack([plane, inner.id], 1), axis=0, return_inverse=True)
    left = np.bincount(which.ravel(), hi - lo + 1, len(code)) if len(code) else np.zeros(0)
    enough = {tuple(c) for c in code[left >= fewest].tolist()}
    of = lambda q: np.fromiter((k in enough for k in zip(q.places()[0].tolist(), q.id.tolist())), bool, len(q.lo))
    return joined(inner.where(of(inner)), p.where(~of(p)))


def rasterised(part: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, pitch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, row, lo, hi): the runs of places inside closed outlines by the even-odd rule, as ``geometry.spans``; the edges belong to numbered parts."""
    keep = (y1 != y2) & np.isfinite(x1) & np.isfinite(x2) & np.isfinite(y1) & np.isfinite(y2)
    part, x1, y1, x2, y2 = part[keep], x1[keep], y1[keep], x2[keep], y2[keep]
    first = np.ceil(np.minimum(y1, y2) / pitch).astype(np.int64)
    e, step = spread(np.maximum(np.ceil(np.maximum(y1, y2) / pitch).astype(np.int64) - first, 0))
    row, part = first[e] + step, part[e]
    cx = x1[e] + (row * pitch - y1[e]) * (x2[e] - x1[e]) / (y2[e] - y1[e])
    order = np.lexsort((cx, row, part))
    part, row, cx = part[order], row[order], cx[order]
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])) if len(part) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(part)))
    _, within = spread(n)
    left = np.flatnonzero((within % 2 == 0) & (within + 1 < np.repeat(n, n)))
    lo, hi = np.ceil(cx[left] / pitch).astype(np.int64), np.ceil(cx[left + 1] / pitch).astype(np.int64) - 1
    keep = lo <= hi
    return part[left[keep]], row[left[keep]], lo[keep], hi[keep]


def block_means(p: Painted, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(plane, y, x, mean) of the numbers at the places of each block of ``factor`` places along each axis; NaN where all are NULL."""
    plane, row, lo, hi = p.places()
    first = lo // factor
    i, step = spread(hi // factor - first + 1)
    y, x = row // factor, first[i] + step
    line = Line.of(plane, y, first, hi // factor, int(plane.max()) + 1 if len(plane) else 0, 0)
    block, which = np.unique(line.at(plane[i], y[i], x), return_inverse=True)
    n = (np.minimum(hi[i], x * factor + factor - 1) - np.maximum(lo[i], x * factor) + 1) * (p.id[i] != NONE)
    with np.errstate(invalid="ignore"):
        mean = np.bincount(which, n * np.where(n, p.id[i], 0).astype(float), len(block)) / np.bincount(which, n, len(block))
    return *line.place(block), mean


def touching(p: Painted) -> np.ndarray:
    """For each run the first run of the connected part (4 neighbours) that it belongs to; numbers play no role."""
    i, j, _, _ = met(p.lo, p.hi, p.lo + p.line.stride, p.hi + p.line.stride)
    part = np.arange(len(p.lo))
    while len(i):
        a, b = part[i], part[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
        while (part[part] != part).any():
            part = part[part]
    return part


def rings(p: Painted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(plane, corners, y, x) of the closed outlines of planes along edges of places, in the order and from the corner that ``geometry.outlines`` gives them; the coordinates of all rings follow one another."""
    stride = p.line.stride
    parts = []
    for side, q in ((-1, without(p, p.lo + stride, p.hi + stride)), (1, without(p, p.lo - stride, p.hi - stride))):
        plane, row, lo, hi = q.places()
        y = row + (side > 0)
        parts.append((plane, y, lo, y, hi + 1) if side < 0 else (plane, y, hi + 1, y, lo))
    plane, row, lo, hi = p.places()
    for down, x in ((True, hi + 1), (False, lo)):
        order = np.lexsort((row, x, plane))
        k, y, at = plane[order], row[order], x[order]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (at[1:] != at[:-1]) | (y[1:] != y[:-1] + 1)])) if len(k) else np.zeros(0, np.int64)
        top, bottom = y[new], y[np.append(new[1:], len(y)) - 1] + 1 if len(y) else y
        parts.append((k[new], *((top, at[new], bottom, at[new]) if down else (bottom, at[new], top, at[new]))))
    plane, ay, ax, by, bx = (np.concatenate(v) for v in zip(*parts))
    order = np.lexsort((ax, ay, plane))
    plane, ay, ax, by, bx = plane[order], ay[order], ax[order], by[order], bx[order]
    if not len(plane):
        return plane, plane, ay, ax
    # each edge is followed by one that starts where it ends; where two do, since corners touch, by the one to the right, so that rings stay simple
    line = Line.of(plane, ay, ax, ax, int(plane.max()) + 1, 1)
    start = line.at(plane, ay, ax)
    after = np.searchsorted(start, line.at(plane, by, bx))
    two = np.append(start[1:] == start[:-1], False)[after]
    left = (by - ay) * (bx[after] - ax[after]) - (bx - ax) * (by[after] - ay[after]) > 0
    after = (after + (two & left)).tolist()
    seen, way, corners = bytearray(len(after)), [], []
    for first in range(len(after)):
        if not seen[first]:
            at, before = first, len(way)
            while not seen[at]:
                seen[at] = 1
                way.append(at)
                at = after[at]
            way.append(first)
            corners.append(len(way) - before)
    way, corners = np.array(way), np.array(corners)
    return plane[way[np.cumsum(corners) - corners]], corners, ay[way], ax[way]


def longest_ways(p: Painted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plane, number, length): of each number of a plane the longest way along its skeleton."""
    plane, row, lo, hi = p.places()
    order = np.lexsort((p.id, plane))
    plane, row, lo, hi, number = plane[order], row[order], lo[order], hi[order], p.id[order]
    new = np.flatnonzero(np.concatenate([[True], (plane[1:] != plane[:-1]) | (number[1:] != number[:-1])])) if len(plane) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(new.tolist(), np.append(new[1:], len(plane)).tolist()):
        y0, x0 = row[a:b].min() - 1, lo[a:b].min() - 1
        grid = np.zeros((row[a:b].max() - y0 + 2, hi[a:b].max() - x0 + 2), bool)
        for y, u, v in zip((row[a:b] - y0).tolist(), (lo[a:b] - x0).tolist(), (hi[a:b] - x0 + 1).tolist()):
            grid[y, u:v] = True
        out.append(morphology.longest_way(morphology.thinned_grid(grid)))
    return plane[new], number[new], np.array(out, float)


def flooded(p: Painted, level: Callable[[np.ndarray, np.ndarray], np.ndarray], nameless: np.ndarray) -> Painted:
    """Watershed from the first place (by row, then column) of each number, as ``morphology.flood``; ``level`` gives whole numbers from 0 for (row, column)."""
    plane, row, lo, hi = p.places()
    new = np.flatnonzero(np.concatenate([[True], plane[1:] != plane[:-1]])) if len(plane) else np.zeros(0, np.int64)
    found = [(p.lo[:0], p.hi[:0], p.id[:0])]
    for a, b in zip(new.tolist(), np.append(new[1:], len(plane)).tolist()):
        if nameless[plane[a]]:
            continue
        y0, x0, width = row[a] - 1, lo[a:b].min() - 1, hi[a:b].max() - lo[a:b].min() + 3
        run, step = spread(hi[a:b] - lo[a:b] + 1)
        y, x = row[a:b][run], lo[a:b][run] + step
        at = (y - y0) * width + x - x0
        numbers_here, first = np.unique(p.id[a:b], return_index=True)
        first = (row[a:b][first] - y0) * width + lo[a:b][first] - x0
        known = numbers_here != NONE
        basin = morphology.flooded_from(at, level(y, x), first[known], int(width), int(row[b - 1] - y0 + 2) * int(width))
        got = basin[at]
        keep = got >= 0
        at, got = at[keep], got[keep]
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (got[1:] != got[:-1])])) if len(at) else np.zeros(0, np.int64)
        y, x = np.divmod(at[head], width)
        start = p.line.at(np.full(len(head), plane[a]), y + y0, x + x0)
        found.append((start, start + np.diff(np.append(head, len(at))) - 1, numbers_here[known][got[head]]))
    return Painted(p.line, *[np.concatenate(v) for v in zip(*found)])


class Shapes(NamedTuple):
    """Runs of polygons (none of a polygon twice) by image: ``shape`` is the polygon's place in ``number``, ``image`` that in ``names``."""

    names: pa.Array
    image: np.ndarray
    number: np.ndarray
    shape: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def nameless(self) -> np.ndarray:
        return self.names.is_null().to_numpy(zero_copy_only=False)

    def painted(self) -> Painted:
        """Each image with the smallest number at each place."""
        plane = self.image[self.shape]
        line = Line.of(plane, self.row, self.lo, self.hi, len(self.names))
        return least(line, line.at(plane, self.row, self.lo), line.at(plane, self.row, self.hi), self.number[self.shape])

    def apart(self, plane: np.ndarray, planes: int) -> Painted:
        """Each shape on the plane told for it, planes apart from each other; the number is the plane."""
        own = plane[self.shape]
        line = Line.of(own, self.row, self.lo, self.hi, planes)
        return least(line, line.at(own, self.row, self.lo), line.at(own, self.row, self.hi), own)


def _flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vertices of each ring, which ring, x, y) of all of over two vertices; NULLs are NaN."""
    n = np.nan_to_num(rings.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    x, y = (v.to_numpy(zero_copy_only=False).astype(float) for v in rings.flatten().flatten())
    ring, _ = spread(n)
    keep = np.repeat(n > 2, n)
    return np.where(n > 2, n, 0), ring[keep], x[keep], y[keep]


def shapes(table: pa.Table, pitch: float) -> Shapes:
    """The runs of polygons of whole images, rows (name, number, ring, holes) in order of the name."""
    table = table.combine_chunks()
    name, rings = (table.column(k).chunk(0) for k in ("name", "ring"))
    number = table.column("number").chunk(0)
    number = np.where(number.is_null().to_numpy(zero_copy_only=False), NONE, number.fill_null(0).to_numpy(zero_copy_only=False))
    coded = name.dictionary_encode("encode")
    image, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def runs(found: pa.Array):
        n, ring, x, y = _flat(found)
        last = np.cumsum(n[n > 0]) - 1
        after = np.arange(1, len(x) + 1)
        after[last] = last - n[n > 0] + 1
        return rasterised(ring, x, y, x[after], y[after], pitch)

    shape, row, lo, hi = runs(rings)
    holes = table.column("holes").chunk(0)
    inner = holes.flatten()
    if len(inner):
        owner, _ = spread(np.nan_to_num(holes.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))
        hole, hrow, hlo, hhi = runs(inner)
        hole = owner[hole]
        outer = np.isin(hole, shape)
        hole, hrow, hlo, hhi = hole[outer], hrow[outer], hlo[outer], hhi[outer]
        line = Line.of(np.append(shape, hole), np.append(row, hrow), np.append(lo, hlo), np.append(hi, hhi), len(image))
        cut = least(line, line.at(hole, hrow, hlo), line.at(hole, hrow, hhi), np.zeros(len(hole), np.int64))
        at = line.at(shape, row, lo)
        order = np.argsort(at)
        left = without(Painted(line, at[order], line.at(shape, row, hi)[order], shape[order]), cut.lo, cut.hi)
        shape, row, lo, hi = left.places()
    return Shapes(names, image, number, shape, row, lo, hi)


def _height(table: pa.Table) -> np.ndarray:
    """Scan lines that a polygon's vertices are passed on the way along its outline, about."""
    rings = table.column("ring").combine_chunks()
    rings = rings.chunk(0) if isinstance(rings, pa.ChunkedArray) else rings
    n, ring, _, y = _flat(rings)
    out = np.zeros(len(n))
    if len(y):
        low, high = np.full(len(n), np.inf), np.full(len(n), -np.inf)
        np.fmin.at(low, ring, y)
        np.fmax.at(high, ring, y)
        out = np.where(low <= high, high - low, 0)
    return 2 * np.nan_to_num(out) + n


def by_image(polys: DataFrame, name: str, number: str, ring: str, holes: str | None, pitch: float, fn: Callable[[Shapes], dict], schema: str) -> DataFrame:
    """``fn`` over the polygons of whole images; it gets ``Shapes`` of one or several images and returns columns of the schema."""
    none = F.lit(None).cast(f"array<{RING}>")
    rows = polys.select(F.col(name).alias("name"), F.col(number).cast("long").alias("number"), F.col(ring).cast(RING).alias("ring"), (F.col(holes).cast(f"array<{RING}>") if holes else none).alias("holes"))
    kept = rows.where(F.size("ring") > 2).repartition(SPREAD * partitions(polys.sparkSession), "name").sortWithinPartitions("name")
    types = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(types)

        def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cost = np.cumsum(_height(table) / pitch)
            names = table.column("name").combine_chunks()
            names = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(np.diff(names)) + 1, len(names))
            begin = 0
            while begin < len(names):
                spent = cost[begin - 1] if begin else 0.0
                k = max(np.searchsorted(cost[ends - 1], spent + CROSSINGS, "right") - 1, np.searchsorted(ends, begin, "right"))
                got = fn(shapes(table.slice(begin, int(ends[k]) - begin), pitch))
                out = pa.table([got[f.name].cast(f.type) if isinstance(got[f.name], pa.Array | pa.ChunkedArray) else pa.array(got[f.name], f.type) for f in target], schema=target)
                yield from out.to_batches(BATCH)
                begin = int(ends[k])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("name").slice(batch.num_rows - 1, 1)
            rest = batch.num_rows
            while rest and batch.column("name").slice(rest - 1, 1).equals(last):
                rest -= 1
            if rest:
                yield from results(pa.Table.from_batches([*waiting, batch.slice(0, rest)]).combine_chunks())
                waiting = [batch.slice(rest)]
            elif waiting and not waiting[-1].column("name").slice(0, 1).equals(last):
                yield from results(pa.Table.from_batches(waiting).combine_chunks())
                waiting = [batch]
            else:
                waiting.append(batch)
        if waiting:
            yield from results(pa.Table.from_batches(waiting).combine_chunks())

    return kept.mapInArrow(run, schema)


def numbers(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NONE)


RUN = "name string, row long, lo long, hi long, id long"


def columns(s: Shapes, p: Painted) -> dict:
    """The columns of RUN."""
    plane, row, lo, hi = p.places()
    return {"name": s.names.take(pa.array(plane)), "row": row, "lo": lo, "hi": hi, "id": numbers(p.id)}


def exploded(runs: DataFrame, name: str, label: str | None) -> DataFrame:
    """(name, y, x, label) of runs in the form of RUN."""
    kept: list[Column] = [F.col("id").alias(label)] if label else []
    return runs.select(F.col("name").alias(name), F.col("row").alias("y"), F.explode(F.sequence("lo", "hi")).alias("x"), *kept)
