"""k-d splits of grouped points: the driver fits a small tree on a bounded sample, executors send rows to its cells.

A cell belongs to one key range, or to one key and a box. The split value of a key node parts whole keys, so no key
needs a halo there; a key that fills a node alone is split on its widest coordinate. A third of all rows under one key
is thus spread over a third of the cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Most rows of the fitting sample on the driver. Only the sizes of cells depend on it, never the result.
SAMPLE_ROWS = 100_000


@dataclass
class KDTree:
    """dim −1: a cell, whose number is in ``child``; dim 0: the key; dim d: coordinate d−1. Rows below ``cut`` go to child, others to child+1."""

    dim: np.ndarray
    cut: np.ndarray
    key_cut: np.ndarray
    child: np.ndarray
    cells: int

    def route(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell that a row's closed box [lo, hi] touches."""
        rows, nodes = np.arange(len(key)), np.zeros(len(key), np.int64)
        out_rows, out_cells = [], []
        while len(rows):
            dim = self.dim[nodes]
            leaf = dim < 0
            if leaf.any():
                out_rows.append(rows[leaf])
                out_cells.append(self.child[nodes[leaf]])
                rows, nodes, dim = rows[~leaf], nodes[~leaf], dim[~leaf]
                if not len(rows):
                    break
            on_key = dim == 0
            at = np.maximum(dim - 1, 0)
            left = np.where(on_key, key[rows] < self.key_cut[nodes], lo[rows, at] < self.cut[nodes])
            right = np.where(on_key, ~left, hi[rows, at] >= self.cut[nodes])
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([self.child[nodes[left]], self.child[nodes[right]] + 1])
        if not out_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_rows), np.concatenate(out_cells)


def fit(key: np.ndarray, coords: np.ndarray, cell_rows: float) -> KDTree:
    """Splits until a node holds at most ``cell_rows`` sampled rows, or holds one key at one place."""
    dim, cut, key_cut, child, cells = [-1], [0.0], [0], [0], 0
    todo = [(0, np.arange(len(key)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) > cell_rows:
            keys = np.sort(key[rows])
            if keys[0] != keys[-1]:
                half = len(keys) // 2
                first, last = np.searchsorted(keys, keys[half]), np.searchsorted(keys, keys[half], "right")
                pick = last if first == 0 or (last < len(keys) and last - half < half - first) else first
                split, d, at = keys[pick], 0, 0.0
                below = key[rows] < split
            else:
                box = coords[rows]
                d = int(np.argmax(np.ptp(box, axis=0))) + 1
                line = np.sort(box[:, d - 1])
                at = line[len(line) // 2]
                if at == line[0]:
                    above = line[line > at]
                    at = above[0] if len(above) else np.nan
                split, below = 0, box[:, d - 1] < at
            if at == at:
                dim[node], cut[node], key_cut[node], child[node] = d, at, split, len(dim)
                for part in (rows[below], rows[~below]):
                    todo.append((len(dim), part))
                    dim.append(-1), cut.append(0.0), key_cut.append(0), child.append(0)
                continue
        child[node] = cells
        cells += 1
    return KDTree(np.array(dim), np.array(cut, float), np.array(key_cut, np.int64), np.array(child, np.int64), cells)


def fit_on(points, coords: list[str], rows: int, cell_rows: int) -> KDTree:
    """Fits on a sample of a DataFrame with the long column ``g1`` and the coordinate columns."""
    fraction = min(1.0, SAMPLE_ROWS / max(rows, 1))
    wanted = points.select("g1", *coords)
    sample = (wanted if fraction == 1.0 else wanted.sample(fraction, seed=11)).limit(2 * SAMPLE_ROWS).toPandas()
    return fit(sample["g1"].to_numpy(np.int64), sample[coords].to_numpy(float), max(8.0, cell_rows * fraction))


def routed(tree_bc, coords: list[str], margin: float, home: bool):
    """A mapInPandas function: each row once for each cell within ``margin``; ``home`` tells the cell that owns it."""

    def run(batches):
        tree = tree_bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            key, xyz = pdf["g1"].to_numpy(np.int64), pdf[coords].to_numpy(float)
            rows, cells = tree.route(key, xyz - margin, xyz + margin)
            out = pdf.iloc[rows].reset_index(drop=True)
            out["cell"] = cells
            if home:
                own_rows, own_cells = tree.route(key, xyz, xyz)
                own = np.empty(len(pdf), np.int64)
                own[own_rows] = own_cells
                out["home"] = own[rows] == cells
            yield out

    return run


def boxes_routed(tree_bc, lo: list[str], hi: list[str], keep: list[str]):
    """As ``routed`` for rows that are boxes."""

    def run(batches):
        tree = tree_bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            rows, cells = tree.route(pdf["g1"].to_numpy(np.int64), pdf[lo].to_numpy(float), pdf[hi].to_numpy(float))
            out = pdf[keep].iloc[rows].reset_index(drop=True)
            out["cell"] = cells
            yield out

    return run


def local_pairs(xyz: np.ndarray, radius: float, leaf: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), each once, of points at most ``radius`` apart: a balanced k-d tree joined with itself level by level."""
    n, dims = xyz.shape
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, bounds, levels = np.arange(n), np.array([0, n]), []
    r2 = radius * radius
    while True:
        p = xyz[order]
        starts = bounds[:-1]
        lo, hi = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
        levels.append((lo, hi))
        sizes = np.diff(bounds)
        if sizes.max() <= leaf or sizes.min() < 2:
            break
        node = np.repeat(np.arange(len(sizes)), sizes)
        widest = np.argmax(hi - lo, axis=1)
        order = order[np.lexsort((p[np.arange(n), widest[node]], node))]
        mids = starts + sizes // 2
        bounds = np.sort(np.concatenate([bounds, mids]))
    a = b = np.zeros(1, np.int64)
    for lo, hi in levels[1:]:
        same = a == b
        a2, b2 = a[~same], b[~same]
        a, b = (
            np.concatenate([2 * a[same], 2 * a[same], 2 * a[same] + 1, 2 * a2, 2 * a2, 2 * a2 + 1, 2 * a2 + 1]),
            np.concatenate([2 * a[same], 2 * a[same] + 1, 2 * a[same] + 1, 2 * b2, 2 * b2 + 1, 2 * b2, 2 * b2 + 1]),
        )
        gap = np.maximum(0, np.maximum(lo[a] - hi[b], lo[b] - hi[a]))
        near = (gap * gap).sum(1) <= r2
        a, b = a[near], b[near]
    sizes, starts = np.diff(bounds), bounds[:-1]
    firsts, seconds = [], []
    step = max(1, 2_000_000 // int(sizes.max() ** 2))
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        pairs = sizes[x] * sizes[y]
        which = np.repeat(np.arange(len(x)), pairs)
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = order[starts[x][which] + k // sizes[y][which]], order[starts[y][which] + k % sizes[y][which]]
        keep = (x[which] != y[which]) | (k // sizes[y][which] < k % sizes[y][which])
        i, j = i[keep], j[keep]
        d = xyz[i] - xyz[j]
        ok = (d * d).sum(1) <= r2
        firsts.append(i[ok])
        seconds.append(j[ok])
    return np.concatenate(firsts) if firsts else np.zeros(0, np.int64), np.concatenate(seconds) if seconds else np.zeros(0, np.int64)


def dense_rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def group_rank(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """A dense number for each distinct tuple of integer columns."""
    rank = dense_rank(pdf[columns[0]].to_numpy())
    for c in columns[1:]:
        other = dense_rank(pdf[c].to_numpy())
        rank = dense_rank(rank * (int(other.max(initial=0)) + 1) + other)
    return rank
