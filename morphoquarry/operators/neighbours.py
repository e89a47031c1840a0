"""Nearest neighbours, neighbourhood statistics and nearest regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphoquarry.operators.kdsplit import fit_on, group_rank, routed
from morphoquarry.operators.proximity import AXES, SWEEP_ROWS, _finite, _keyed, near_pairs, polygon_edges
from morphoquarry.session import Cut

#: Rows of a cell in which every query is held against every row of its group.
KNN_CELL = 2_000


def _best(query: pd.DataFrame, base: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of base with equal group for each query, itself left out; ties go to the smaller id."""
    rank = group_rank(pd.concat([query[["g1", "g2"]], base[["g1", "g2"]]], ignore_index=True), ["g1", "g2"])
    qr, br = rank[: len(query)], rank[len(query) :]
    order = np.lexsort((base["id"].to_numpy(), br))
    ids, xyz, br = base["id"].to_numpy()[order], base[AXES].to_numpy(float)[order], br[order]
    out = []
    for g in np.unique(qr):
        lo, hi = np.searchsorted(br, g), np.searchsorted(br, g, "right")
        if lo == hi:
            continue
        rows = np.flatnonzero(qr == g)
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            q = query[AXES].to_numpy(float)[part]
            d2 = ((q[:, None, :] - xyz[None, lo:hi]) ** 2).sum(2)
            d2[query["id"].to_numpy()[part][:, None] == ids[None, lo:hi]] = np.inf
            near = np.argsort(d2, axis=1, kind="stable")[:, :k]
            i, j = np.repeat(part, near.shape[1]), near.ravel()
            d = d2[np.repeat(np.arange(len(part)), near.shape[1]), j]
            out.append(pd.DataFrame({"id": query["id"].to_numpy()[i], "neighbour": ids[lo + j], "distance": np.sqrt(d)})[np.isfinite(d)])
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": np.zeros(0, int), "neighbour": np.zeros(0, int), "distance": np.zeros(0)})


def nearest_neighbours(df: DataFrame, id_col: str, coords: list[Column], keys: list[Column], k: int, rows: int | None = None, cell_rows: int = KNN_CELL) -> DataFrame:
    """(id, neighbour, distance, rank) of the k nearest rows with equal keys; ties go to the smaller id.

    A first pass within k-d cells bounds how far the k-th neighbour can be; each row then visits the cells its ball
    touches. Groups of one row have no neighbours, smaller groups than k + 1 fewer. NULL, NaN and repeated ids as in
    ``near_pairs``.
    """
    usable = F.col(id_col).isNotNull()
    for c in keys:
        usable &= c.isNotNull()
    for c in coords:
        usable &= _finite(c.cast("double"))
    padded = [c.cast("double") for c in coords] + [F.lit(0.0)] * (3 - len(coords))
    points = df.where(usable).select(F.col(id_col).cast("long").alias("id"), *_keyed(keys), *[c.alias(a) for c, a in zip(padded, AXES)]).dropDuplicates(["id"])
    tree = df.sparkSession.sparkContext.broadcast(fit_on(points, AXES, rows if rows is not None else points.count(), cell_rows))
    row = "id long, g1 long, g2 int, c0 double, c1 double, c2 double, cell long"
    home = points.mapInPandas(routed(tree, AXES, 0.0, False), row)

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        near = _best(pdf, pdf, k)
        reach = near.groupby("id")["distance"].agg(["size", "max"])
        far = reach["max"].where(reach["size"] == k, np.inf)
        return pdf.drop(columns="cell").assign(reach=pdf["id"].map(far).fillna(np.inf).to_numpy())

    bounded = home.groupBy("cell").applyInPandas(bound, "id long, g1 long, g2 int, c0 double, c1 double, c2 double, reach double")

    def visit(batches):
        fitted = tree.value
        for pdf in batches:
            if len(pdf):
                xyz, far = pdf[AXES].to_numpy(float), pdf["reach"].to_numpy(float)[:, None]
                r, cells = fitted.route(pdf["g1"].to_numpy(np.int64), xyz - far, xyz + far)
                yield pdf.drop(columns="reach").iloc[r].assign(cell=cells)

    queries = bounded.mapInPandas(visit, row)
    found = queries.groupBy("cell").cogroup(home.groupBy("cell")).applyInPandas(lambda q, b: _best(q, b, k), "id long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(id, neighbour) from pairs (id_a, id_b)."""
    return pairs.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("neighbour")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("neighbour")))).alias("p")).select("p.*")


def neighbour_statistics(links: DataFrame, values: DataFrame, id_col: str, value: str, least: int = 1) -> DataFrame:
    """(id, n, value, mean, sd, delta): a feature of the neighbours; sd has n − 1 and is 0 for one; delta is the mean less the own value.

    Neighbours without a value don't count; rows with fewer than ``least`` are left out.
    """
    v = values.select(F.col(id_col).alias("neighbour"), F.col(value).alias("_v")).where("_v IS NOT NULL")
    own = values.select(F.col(id_col).alias("id"), F.col(value).alias("value"))
    stats = links.join(v, "neighbour").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("sd"))
    return stats.where(F.col("n") >= least).join(own, "id").select("id", "n", "value", "mean", "sd", (F.col("mean") - F.col("value")).alias("delta"))


def sampling_moments(stats: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """Adds null_mean, null_sd and z: what the mean of n members drawn from the pool without replacement would be.

    ``pools`` has the keys, pool_n, pool_mean and pool_sd (over all members, ddof 0). z is 0 where null_sd is 0 and NULL
    where the pool has no more than n members.
    """
    size = F.col("pool_n").cast("double")
    variance = F.col("pool_sd") * F.col("pool_sd") / F.col("n") * F.try_divide(size - F.col("n"), size - 1)
    out = stats.join(pools, keys).withColumn("null_mean", F.col("pool_mean")).withColumn("null_sd", F.sqrt(variance))
    z = F.coalesce(F.try_divide(F.col("mean") - F.col("null_mean"), F.col("null_sd")), F.lit(0.0))
    return out.withColumn("z", F.when(F.col("pool_n") > F.col("n"), z))


def nearest_within(left: DataFrame, right: DataFrame, id_col: str, coords: list[str], keys: list[str], radius: float, strict: bool = True) -> DataFrame:
    """(id, match, distance): the nearest right row with equal keys within the radius; ties go to the smaller id. A right row may match many."""
    a = left.select(F.col(id_col).alias("id"), *keys, *coords, F.lit(0).alias("side"))
    b = right.select(F.col(id_col).alias("id"), *keys, *coords, F.lit(1).alias("side"))
    both = a.unionAll(b).withColumn("_mq", F.col("id") * 2 + F.col("side"))
    links = both_ways(near_pairs(both, "_mq", [F.col(c) for c in coords], [F.col(k) for k in keys], radius))
    links = links.where((F.col("id") % 2 == 0) & (F.col("neighbour") % 2 == 1))
    at = lambda df, s: df.select(F.col("_mq").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in coords])
    full = links.join(at(both, "id"), "id").join(at(both, "neighbour"), "neighbour")
    distance = F.sqrt(sum(((F.col(f"id_{c}") - F.col(f"neighbour_{c}")) * (F.col(f"id_{c}") - F.col(f"neighbour_{c}")) for c in coords), F.lit(0.0)))
    full = full.withColumn("distance", distance)
    if strict:
        full = full.where(F.col("distance") < radius)
    best = full.groupBy("id").agg(F.min(F.struct("distance", "neighbour")).alias("s"))
    return best.select((F.col("id") / 2).cast("long").alias("id"), ((F.col("s.neighbour") - 1) / 2).cast("long").alias("match"), F.col("s.distance").alias("distance"))


def outline_distances(points: DataFrame, id_col: str, x: Column, y: Column, point_keys: list[Column], polygons: DataFrame, poly_id: str, ring: str, holes: str, poly_keys: list[Column], radius: float, rows: int | None = None, cell_rows: int = 20_000) -> DataFrame:
    """(id, poly, distance) of polygons with equal keys whose outline comes within the radius of a point."""
    usable = F.col(id_col).isNotNull() & _finite(x) & _finite(y)
    for c in point_keys:
        usable &= c.isNotNull()
    pts = points.where(usable).select(F.col(id_col).cast("long").alias("id"), *_keyed(point_keys), x.cast("double").alias("c0"), y.cast("double").alias("c1"))
    tree = points.sparkSession.sparkContext.broadcast(fit_on(pts, ["c0", "c1"], rows if rows is not None else pts.count(), cell_rows))
    at = pts.mapInPandas(routed(tree, ["c0", "c1"], 0.0, False), "id long, g1 long, g2 int, c0 double, c1 double, cell long")
    flat = polygon_edges(polygons, poly_id, ring, holes, poly_keys, flat=True)

    def send(batches):
        fitted = tree.value
        for pdf in batches:
            if len(pdf):
                xs, ys = pdf[["x1", "x2"]].to_numpy(float), pdf[["y1", "y2"]].to_numpy(float)
                lo = np.column_stack([xs.min(1), ys.min(1)]) - radius
                hi = np.column_stack([xs.max(1), ys.max(1)]) + radius
                r, cells = fitted.route(pdf["g1"].to_numpy(np.int64), lo, hi)
                yield pdf[["poly", "g1", "g2", "x1", "y1", "x2", "y2"]].iloc[r].assign(cell=cells)

    cut = flat.mapInPandas(send, "poly long, g1 long, g2 int, x1 double, y1 double, x2 double, y2 double, cell long")

    def measure(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("id", ignore_index=True)
        e = e.drop_duplicates(ignore_index=True)
        out = [pd.DataFrame({"id": np.zeros(0, int), "poly": np.zeros(0, int), "distance": np.zeros(0)})]
        if len(p) and len(e):
            groups = group_rank(pd.concat([p[["g1", "g2"]], e[["g1", "g2"]]], ignore_index=True), ["g1", "g2"])
            pg, eg = groups[: len(p)], groups[len(p) :]
            px, py = p["c0"].to_numpy(float), p["c1"].to_numpy(float)
            x1, y1, x2, y2 = (e[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
            order = np.lexsort((px, pg))
            lift = 2 * float(max(np.abs(px).max(), np.abs(x1).max(), np.abs(x2).max())) + 2 * radius + 2
            line = pg[order] * lift + px[order]
            slack = abs(line[-1]) * 1e-14
            first, last = np.searchsorted(pg[order], eg), np.searchsorted(pg[order], eg, "right")
            lo = np.clip(np.searchsorted(line, eg * lift + np.minimum(x1, x2) - radius - slack), first, last)
            hi = np.clip(np.searchsorted(line, eg * lift + np.maximum(x1, x2) + radius + slack, "right"), first, last)
            count, at = np.maximum(hi - lo, 0), 0
            total = np.cumsum(count)
            while at < len(count):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SWEEP_ROWS, "right")))
                n = count[at:upto]
                k = np.repeat(np.arange(at, upto), n)
                i = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:upto], n)]
                near = (py[i] >= np.minimum(y1[k], y2[k]) - radius) & (py[i] <= np.maximum(y1[k], y2[k]) + radius)
                k, i = k[near], i[near]
                dx, dy = x2[k] - x1[k], y2[k] - y1[k]
                t = np.clip(((px[i] - x1[k]) * dx + (py[i] - y1[k]) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
                d = np.hypot(px[i] - (x1[k] + t * dx), py[i] - (y1[k] + t * dy))
                near = d <= radius
                out.append(pd.DataFrame({"id": p["id"].to_numpy()[i[near]], "poly": e["poly"].to_numpy()[k[near]], "distance": d[near]}))
                at = upto
        return pd.concat(out).groupby(["id", "poly"], as_index=False)["distance"].min()

    return at.groupBy("cell").cogroup(cut.groupBy("cell")).applyInPandas(measure, "id long, poly long, distance double")


def nearest_outlines(points: DataFrame, id_col: str, x: Column, y: Column, key: str, polygons: DataFrame, poly_id: str, ring: str, holes: str, cut: Cut, first: float = 25.0) -> DataFrame:
    """(id, poly, distance): outlines of polygons with the point's key that come nearest, at least the nearest of each point, however far it is.

    Points without one within ``first`` are looked at again with four times the radius. Points whose key has no polygon
    with an outline, or whose coordinates are NULL, NaN or infinite, have no row.
    """
    drawn = F.exists(F.concat(F.array(ring), F.coalesce(holes, F.array())), lambda r: F.size(F.filter(r, lambda p: p.isNotNull() & _finite(p["x"]) & _finite(p["y"]))) > 2)
    has = polygons.where(drawn & F.col(poly_id).isNotNull()).select(key).distinct()
    left = cut.table(points.where(F.col(id_col).isNotNull() & _finite(x) & _finite(y)).join(has, key, "left_semi").select(F.col(id_col).alias("_id"), F.col(key), x.alias("_x"), y.alias("_y")))
    radius, out = first, None
    while True:
        found = cut.table(outline_distances(left, "_id", F.col("_x"), F.col("_y"), [F.col(key)], polygons, poly_id, ring, holes, [F.col(key)], radius))
        out = found if out is None else out.unionAll(found)
        left = cut.table(left.join(found.select(F.col("id").alias("_id")), "_id", "left_anti"))
        if not left.limit(1).count():
            return out
        radius *= 4
