"""Graphs of edges (src, dst, weight): components, degrees, triangles, and measures of small networks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphoquarry.session import Cut


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that a node is linked to, for edges (src, dst) of long ids in either direction.

    Alternating large-star and small-star rounds, a logarithm of the component's size in number. Stars of a hub are
    not gathered: each round moves links, one row each. NULL ends and loops are left out; nodes without links are their
    own component if ``nodes`` (id) has them.
    """
    spark, cut = edges.sparkSession, Cut(edges.sparkSession)
    links = cut.table(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v")).distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = low.where("u <> m").select("u", F.col("m").alias("v"))
        return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own).where("u <> v").distinct()

    before = None
    while True:
        step = cut.table(star(star(links, True), False))
        now = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cut.drop(links)
        links = step
        if tuple(now) == before:
            break
        before = tuple(now)
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(links.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    if nodes is None:
        return found
    return nodes.select(F.col("id").cast("long").alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def threshold_edges(pairs: DataFrame, a: str, b: str, r: str, least: float, absolute: bool = True) -> DataFrame:
    """Edges of pairs whose correlation, or its size, reaches a threshold; the weight keeps the sign, abs_weight doesn't."""
    strength = F.abs(F.col(r)) if absolute else F.col(r)
    return pairs.where(strength >= least).withColumnsRenamed({a: "src", b: "dst", r: "weight"}).withColumn("abs_weight", F.abs("weight"))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, degree, strength, abs_strength) of undirected edges listed once."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"), F.sum(F.abs("weight")).alias("abs_strength"))


def triangles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, triangles) by joining edges ordered from the node of smaller degree, so a hub's links aren't paired."""
    deg = degrees(edges, keys).select(*keys, "node", "degree")
    e = edges.select(*keys, "src", "dst").join(deg.withColumnsRenamed({"node": "src", "degree": "_ds"}), [*keys, "src"]).join(deg.withColumnsRenamed({"node": "dst", "degree": "_dd"}), [*keys, "dst"])
    forward = (F.col("_ds") < F.col("_dd")) | ((F.col("_ds") == F.col("_dd")) & (F.col("src") < F.col("dst")))
    o = e.select(*keys, F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("b"))
    first, second = o.select(*keys, "a", "b"), o.select(*keys, "a", F.col("b").alias("c"))
    wedges = first.join(second, [*keys, "a"]).where("b <> c")
    closed = wedges.join(o.select(*keys, F.col("a").alias("b"), F.col("b").alias("c")), [*keys, "b", "c"])
    return closed.select(*keys, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, degree, triangles, clustering): closed share of a node's pairs of neighbours, 0 below two."""
    both = degrees(edges, keys).join(triangles(edges, keys), [*keys, "node"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return both.select(*keys, "node", "degree", "triangles", F.coalesce(F.try_divide(2.0 * F.col("triangles"), pairs.cast("double")), F.lit(0.0)).alias("clustering"))


def density(edges: DataFrame, keys: list[str]) -> DataFrame:
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
    n = ends.groupBy(*keys).agg(F.count_distinct("node").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    return n.withColumn("density", F.try_divide(2.0 * F.col("edges"), (F.col("nodes") * (F.col("nodes") - 1)).cast("double")))


def _distances(adj: list[list[int]], start: int) -> tuple[list[int], list[list[int]], list[float], list[int]]:
    """Hops, predecessors, numbers of shortest ways and order of visits from a node."""
    dist, before, ways, order = [-1] * len(adj), [[] for _ in adj], [0.0] * len(adj), []
    dist[start], ways[start], queue = 0, 1.0, [start]
    for at in queue:
        order.append(at)
        for to in adj[at]:
            if dist[to] < 0:
                dist[to] = dist[at] + 1
                queue.append(to)
            if dist[to] == dist[at] + 1:
                ways[to] += ways[at]
                before[to].append(at)
    return dist, before, ways, order


def _betweenness(adj: list[list[int]]) -> list[float]:
    out = [0.0] * len(adj)
    for s in range(len(adj)):
        _, before, ways, order = _distances(adj, s)
        share = [0.0] * len(adj)
        for v in reversed(order):
            for p in before[v]:
                share[p] += ways[p] / ways[v] * (1 + share[v])
            if v != s:
                out[v] += share[v]
    n = len(adj)
    return [v / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v in out]


def _cores(adj: list[list[int]]) -> list[int]:
    left, core, level = {i: set(a) for i, a in enumerate(adj)}, [0] * len(adj), 0
    while left:
        at = min(left, key=lambda i: (len(left[i]), i))
        level = max(level, len(left[at]))
        core[at] = level
        for to in left.pop(at):
            left[to].discard(at)
    return core


def _modules(weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Communities by joining, as long as it gains, the pair with the greatest gain in modularity."""
    n, total = len(weight), weight.sum()
    if not total:
        return np.arange(n), 0.0
    member, share = np.arange(n), weight / total
    while True:
        a, sums = share, share.sum(1)
        gain = 2 * (a - np.outer(sums, sums))
        gain[a <= 0] = -np.inf
        np.fill_diagonal(gain, -np.inf)
        i, j = divmod(int(gain.argmax()), len(gain)) if len(gain) > 1 else (0, 0)
        if len(gain) < 2 or gain[i, j] <= 1e-12:
            return member, float(np.trace(a) - (sums**2).sum())
        i, j = min(i, j), max(i, j)
        share = a.copy()
        share[i] += share[j]
        share[:, i] += share[:, j]
        share = np.delete(np.delete(share, j, 0), j, 1)
        member = np.where(member == j, i, np.where(member > j, member - 1, member))


def network_of(pdf: pd.DataFrame, random_graphs: int = 10, seed: int = 1) -> tuple[pd.DataFrame, dict]:
    """Node and graph measures of one network of modest size (its nodes are the columns of a correlation matrix)."""
    nodes = sorted(set(pdf["src"]) | set(pdf["dst"]))
    at = {v: i for i, v in enumerate(nodes)}
    n = len(nodes)
    w = np.zeros((n, n))
    for s, t, x in zip(pdf["src"], pdf["dst"], pdf["weight"]):
        w[at[s], at[t]] = w[at[t], at[s]] = x
    adj = [list(np.flatnonzero(w[i])) for i in range(n)]

    def shape(adj: list[list[int]]) -> tuple[float, float]:
        sets = [set(a) for a in adj]
        local = [2 * sum(len(sets[i] & sets[j]) for j in a) / 2 / (len(a) * (len(a) - 1)) if len(a) > 1 else 0.0 for i, a in enumerate(adj)]
        seen, best = set(), []
        for s in range(len(adj)):
            if s not in seen:
                part = [i for i, d in enumerate(_distances(adj, s)[0]) if d >= 0]
                seen.update(part)
                best = max(best, part, key=len)
        hops = [d for s in best for d in _distances(adj, s)[0] if d > 0]
        return sum(local) / max(1, len(adj)), (sum(hops) / len(hops) if hops else math.nan)

    c, length = shape(adj)
    rng, m = np.random.default_rng(seed), int((w != 0).sum() // 2)
    pairs = np.array([(i, j) for i in range(n) for j in range(i + 1, n)])
    others = []
    for _ in range(random_graphs):
        graph: list[list[int]] = [[] for _ in range(n)]
        for i, j in pairs[rng.permutation(len(pairs))[:m]]:
            graph[i].append(int(j))
            graph[j].append(int(i))
        others.append(shape(graph))
    cr, lr = (np.nanmean([o[k] for o in others]) for k in (0, 1)) if others else (math.nan, math.nan)
    sigma = (c / cr) / (length / lr) if others and cr > 0 and lr > 0 and length > 0 else math.nan
    degree = np.array([len(a) for a in adj], float)
    x, y = np.array([degree[i] for i in range(n) for j in adj[i]]), np.array([degree[j] for i in range(n) for j in adj[i]])
    assort = float(np.corrcoef(x, y)[0, 1]) if len(x) and x.std() > 0 else math.nan
    vector = np.ones(n)
    for _ in range(500):
        new = np.abs(w) @ vector + vector
        vector = new / np.linalg.norm(new)
    member, modularity = _modules(np.abs(w))
    table = pd.DataFrame({"node": nodes, "betweenness": _betweenness(adj), "eigenvector": vector, "core": _cores(adj), "module": member.astype("int64")})
    return table, {"nodes": n, "edges": m, "clustering": c, "path_length": length, "small_world": sigma, "assortativity": assort, "modularity": modularity}


def network_measures(edges: DataFrame, key: str) -> DataFrame:
    """One row per network: nodes, edges, clustering, path_length (of the largest part), small_world, assortativity, modularity; NULL where undefined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: pdf[key].iloc[0], **network_of(pdf)[1]}])

    kind = edges.schema[key].dataType.simpleString()
    out = edges.select(key, "src", "dst", "weight").groupBy(key).applyInPandas(run, f"{key} {kind}, nodes long, edges long, clustering double, path_length double, small_world double, assortativity double, modularity double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, k in out.dtypes if k == "double"})


def node_measures(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, betweenness, eigenvector, core, module) per network."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return network_of(pdf, 0)[0].assign(**{key: pdf[key].iloc[0]})[[key, "node", "betweenness", "eigenvector", "core", "module"]]

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.select(key, "src", "dst", "weight").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, node {kinds['src']}, betweenness double, eigenvector double, core long, module long")
