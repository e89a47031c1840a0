"""Points near other points, and the regions that contain points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphoquarry.operators.kdsplit import boxes_routed, dense_rank, fit_on, group_rank, local_pairs, routed

#: Rows that a cell should hold: about 3 MB as a local k-d tree.
CELL_ROWS = 40_000
AXES = ["c0", "c1", "c2"]
#: Edge-and-point candidates held at once by the sweep.
SWEEP_ROWS = 1_500_000


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def _keyed(keys: list[Column]) -> list[Column]:
    """The group as 96 bits: two independent hashes, the first of which also orders groups in the k-d tree."""
    return [F.xxhash64(*keys).alias("g1"), F.hash(*keys).alias("g2")]


def unit_vector(lon: Column, lat: Column) -> list[Column]:
    """Degrees to a point on the unit sphere; a great-circle distance d on radius R is the chord 2·sin(d / 2R)."""
    lon, lat = F.radians(lon), F.radians(lat)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def near_pairs(df: DataFrame, id_col: str, coords: list[Column], keys: list[Column], radius: float, sphere: float | None = None, rows: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs (id_a < id_b) of rows with equal keys at most ``radius`` apart.

    ``coords``: up to three numbers of a flat space, or longitude and latitude in degrees if ``sphere`` gives the radius
    of a sphere; these become unit vectors and the radius a chord. Space is parted by k-d splits over (key, place), each
    row is copied to the cells within the radius, and each cell joins its local k-d tree with itself; the cell that owns
    the smaller id reports the pair. Rows with a NULL key or a NULL, NaN or infinite coordinate have no neighbours;
    rows with the same id count once (their coordinates must agree). Distances equal to the radius count.
    """
    reach = float(radius)
    if sphere is not None:
        coords = unit_vector(*coords)
        reach = 2 * math.sin(min(radius / sphere, math.pi) / 2)
    coords = [c.cast("double") for c in coords]
    usable = F.lit(True)
    for k in keys:
        usable &= k.isNotNull()
    for c in coords:
        usable &= _finite(c)
    padded = coords + [F.lit(0.0)] * (3 - len(coords))
    points = df.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *_keyed(keys), *[c.alias(a) for c, a in zip(padded, AXES)])
    spark = df.sparkSession
    tree = spark.sparkContext.broadcast(fit_on(points, AXES, rows if rows is not None else points.count(), cell_rows))
    parts = points.mapInPandas(routed(tree, AXES, reach, True), "id long, g1 long, g2 int, c0 double, c1 double, c2 double, cell long, home boolean")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id", ignore_index=True)
        rank = group_rank(pdf, ["g1", "g2"])
        space = np.column_stack([rank * (2.0 * reach + 1.0), pdf[AXES].to_numpy(float)])
        i, j = local_pairs(space, reach)
        ids, home = pdf["id"].to_numpy(), pdf["home"].to_numpy(bool)
        swap = ids[i] > ids[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        mine = home[a]
        return pd.DataFrame({"id_a": ids[a[mine]], "id_b": ids[b[mine]]})

    return parts.groupBy("cell").applyInPandas(pairs, "id_a long, id_b long")


def polygon_edges(df: DataFrame, poly_id: str, ring: str, holes: str, keys: list[Column], flat: bool = False) -> DataFrame:
    """One row per edge, with the box in which it can matter to a ray towards +x: from the left end of its ring.

    Rings are closed if they aren't; vertices that are NULL or hold NULL or NaN are left out; a NULL list of holes is
    none. Rings of one or two vertices enclose nothing. ``flat`` keeps edges along x, which no ray towards +x crosses.
    """
    shape = "array<array<struct<x:double,y:double>>>"
    first = F.when(F.col(ring).isNotNull(), F.array(F.col(ring))).otherwise(F.array()).cast(shape)
    rest = F.coalesce(F.col(holes).cast(shape), F.array().cast(shape))
    usable = F.col(poly_id).isNotNull()
    for k in keys:
        usable &= k.isNotNull()
    rings = df.where(usable).select(F.col(poly_id).cast("long").alias("poly"), *_keyed(keys), F.posexplode(F.concat(first, rest)).alias("ring", "pts"))
    clean = F.filter("pts", lambda p: p.isNotNull() & _finite(p["x"]) & _finite(p["y"]))
    rings = rings.select("poly", "g1", "g2", "ring", clean.alias("pts")).where(F.size("pts") > 2)
    rings = rings.select("*", F.array_min(F.transform("pts", lambda p: p["x"])).alias("left"), F.slice("pts", 1, 1).alias("head"))
    edges = F.arrays_zip(F.col("pts").alias("a"), F.concat(F.expr("slice(pts, 2, size(pts) - 1)"), F.col("head")).alias("b"))
    out = rings.select("poly", "g1", "g2", "ring", "left", F.posexplode(edges).alias("edge", "e"))
    x1, y1, x2, y2 = F.col("e.a.x"), F.col("e.a.y"), F.col("e.b.x"), F.col("e.b.y")
    out = out.select("poly", "g1", "g2", "ring", "edge", "left", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return (out if flat else out.where("y1 <> y2")).withColumns({"right": F.greatest("x1", "x2"), "low": F.least("y1", "y2"), "high": F.greatest("y1", "y2")})


def _sweep(px: np.ndarray, py: np.ndarray, pg: np.ndarray, e: dict[str, np.ndarray], eg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ring number, point) for points inside a ring by the even-odd rule.

    The sweep line moves along (group, y): an edge is active for one run of the points in that order, found by bisection
    of its two ends, and toggles the active points to the left of it. Lower ends belong to an edge, upper ends don't.
    """
    order = np.lexsort((py, pg))
    top = float(max(np.abs(py).max(initial=0), np.abs(e["y1"]).max(initial=0), np.abs(e["y2"]).max(initial=0)))
    lift = 2 * top + 2
    # the order key is (group, y), each compared as such: bisection inside the group's run
    starts = np.searchsorted(pg[order], eg, "left")
    ends = np.searchsorted(pg[order], eg, "right")
    line = pg[order] * lift + py[order]
    low, high = np.minimum(e["y1"], e["y2"]), np.maximum(e["y1"], e["y2"])
    slack = np.abs(line[-1] if len(line) else 0) * 1e-14
    a = np.clip(np.searchsorted(line, eg * lift + low - slack, "left"), starts, ends)
    b = np.clip(np.searchsorted(line, eg * lift + high + slack, "right"), starts, ends)
    count = np.maximum(b - a, 0)
    rings, points = [], []
    at, total = 0, np.cumsum(count)
    while at < len(count):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SWEEP_ROWS, "right")))
        n = count[at:upto]
        edge = np.repeat(np.arange(at, upto), n)
        p = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[at:upto], n)]
        y = py[p]
        active = (e["y1"][edge] <= y) != (e["y2"][edge] <= y)
        edge, p, y = edge[active], p[active], y[active]
        x1, y1 = e["x1"][edge], e["y1"][edge]
        cross = x1 + (y - y1) * (e["x2"][edge] - x1) / (e["y2"][edge] - y1)
        hit = px[p] < cross
        rings.append(e["ring_no"][edge[hit]])
        points.append(p[hit])
        at = upto
    if not rings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both, times = np.unique(np.concatenate(rings).astype(np.int64) * len(px) + np.concatenate(points), return_counts=True)
    odd = both[times % 2 == 1]
    return odd // max(len(px), 1), odd % max(len(px), 1)


def containing_polygons(points: DataFrame, id_col: str, x: Column, y: Column, point_keys: list[Column], polygons: DataFrame, poly_id: str, ring: str, holes: str, poly_keys: list[Column], rows: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, poly): polygons with equal keys whose ring holds the point and none of whose holes does.

    Even-odd rule, ring by ring; a lower or left outline counts as inside, an upper or right one as outside. Points are
    parted by k-d splits over (key, place); each edge goes to the cells in which it can decide, where a plane sweep
    counts crossings. Rows with NULL keys, ids or coordinates match nothing; repeated ids count once.
    """
    usable = F.col(id_col).isNotNull() & _finite(x) & _finite(y)
    for k in point_keys:
        usable &= k.isNotNull()
    pts = points.where(usable).select(F.col(id_col).cast("long").alias("id"), *_keyed(point_keys), x.cast("double").alias("c0"), y.cast("double").alias("c1"))
    edges = polygon_edges(polygons, poly_id, ring, holes, poly_keys)
    tree = points.sparkSession.sparkContext.broadcast(fit_on(pts, ["c0", "c1"], rows if rows is not None else pts.count(), cell_rows))
    at = pts.mapInPandas(routed(tree, ["c0", "c1"], 0.0, False), "id long, g1 long, g2 int, c0 double, c1 double, cell long")
    keep = ["poly", "g1", "g2", "ring", "edge", "x1", "y1", "x2", "y2"]
    cut = edges.mapInPandas(boxes_routed(tree, ["left", "low"], ["right", "high"], keep), "poly long, g1 long, g2 int, ring int, edge int, x1 double, y1 double, x2 double, y2 double, cell long")

    def inside(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("id", ignore_index=True)
        e = e.drop_duplicates(["poly", "ring", "edge"], ignore_index=True)
        if not len(p) or not len(e):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "poly": np.zeros(0, np.int64)})
        groups = group_rank(pd.concat([p[["g1", "g2"]], e[["g1", "g2"]]], ignore_index=True), ["g1", "g2"])
        pg, eg = groups[: len(p)], groups[len(p) :]
        poly_no = dense_rank(e["poly"].to_numpy())
        ring_no = dense_rank(poly_no * (int(e["ring"].max()) + 1) + e["ring"].to_numpy())
        cols = {c: e[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2")} | {"ring_no": ring_no}
        first = np.zeros(ring_no.max() + 1, np.int64)
        first[ring_no] = np.arange(len(e))
        hit_ring, hit_point = _sweep(p["c0"].to_numpy(float), p["c1"].to_numpy(float), pg, cols, eg)
        row = first[hit_ring]
        outer = e["ring"].to_numpy()[row] == 0
        code = poly_no[row] * len(p) + hit_point
        good = np.setdiff1d(code[outer], code[~outer])
        name = np.zeros(poly_no.max() + 1, np.int64)
        name[poly_no] = e["poly"].to_numpy()
        return pd.DataFrame({"id": p["id"].to_numpy()[good % len(p)], "poly": name[good // len(p)]})

    return at.groupBy("cell").cogroup(cut.groupBy("cell")).applyInPandas(inside, "id long, poly long")
