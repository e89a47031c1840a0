"""Problem 7: groups of similar records by cluster-feature trees, Ward agglomeration and one assignment pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphoquarry.session import Cut
from morphoquarry.sources.tables import table

#: Leaf entries of a tree; a full tree is rebuilt with a larger radius, unless its entries are groups of their own already
#: (half of them of several records, nine in ten further than APART radii from the next): then the tree may grow to twice as many.
LEAVES, APART = 400, 3
#: Radius of a leaf entry to begin with, in standard deviations.
RADIUS = 0.05
#: Trees merged at a time in the reduction.
FAN_IN = 16
#: Most groups whose leaves and statistics are broadcast; more are joined by group, large groups in parts of PART_ROWS.
BROADCAST_GROUPS = 500
PART_ROWS = 100_000
NUM_COLS = ("intensity_mean", "area", "eccentricity", "intensity_std")


class FeatureTree:
    """A two-level tree of cluster features (count, sum, sum of squared norms): inner nodes route to leaf entries.

    A record joins the nearest leaf entry of the nearest inner node if it lies within the radius of its centroid, else
    it founds one. Entries of other trees are inserted the same way, so trees merge.
    """

    def __init__(self, dims: int, radius: float = RADIUS, leaves: int = LEAVES):
        self.dims, self.radius, self.limit = dims, radius, leaves
        self._clear()

    def _clear(self) -> None:
        self.count, self.total, self.square = np.zeros(0), np.zeros((0, self.dims)), np.zeros(0)
        self.node, self.node_count, self.node_total = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, self.dims))

    def insert(self, count: np.ndarray, total: np.ndarray, square: np.ndarray) -> None:
        for at in range(0, len(count), 2048):
            rest = np.arange(at, min(at + 2048, len(count)))
            while len(rest):
                rest = rest[self._block(count[rest], total[rest], square[rest])]
                while len(self.count) > self.limit:
                    if self._parted():
                        self.limit *= 2
                        continue
                    old = (self.count, self.total, self.square)
                    self.radius *= 1.5
                    self._clear()
                    left = np.arange(len(old[0]))
                    while len(left):
                        left = left[self._block(*[x[left] for x in old])]

    def _parted(self) -> bool:
        centres = self.total / self.count[:, None]
        many = self.count >= 2
        if many.mean() < 0.5:
            return False
        near = np.array([np.partition(((centres - c) ** 2).sum(1), 1)[1] for c in centres])
        return bool((near > (APART * self.radius) ** 2).mean() >= 0.9)

    def _block(self, count: np.ndarray, total: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Takes in a block; returns the rows left out because they would found more entries than a tree may hold for a while."""
        points = total / count[:, None]
        target = np.full(len(points), -1, np.int64)
        if len(self.count):
            inner = _nearest(points, self.node_total / self.node_count[:, None])[0]
            centres = self.total / self.count[:, None]
            for node in np.unique(inner):
                rows, leaves = np.flatnonzero(inner == node), np.flatnonzero(self.node == node)
                if len(leaves):
                    best, d2 = _nearest(points[rows], centres[leaves])
                    near = d2 <= self.radius**2
                    target[rows[near]] = leaves[best[near]]
        rest = np.flatnonzero(target < 0)
        while len(rest) and len(self.count) <= self.limit + 100:  # each round founds one entry and takes in all within its radius
            centre = points[rest[0]]
            near = ((points[rest] - centre) ** 2).sum(1) <= self.radius**2
            target[rest[near]] = len(self.count)
            nodes = self.node_total / self.node_count[:, None]
            d2 = ((nodes - centre) ** 2).sum(1)
            if len(d2) and d2.min() <= (6 * self.radius) ** 2:
                node = int(d2.argmin())
            else:
                node = len(self.node_count)
                self.node_count, self.node_total = np.append(self.node_count, 1e-9), np.vstack([self.node_total, centre * 1e-9])
            self.node = np.append(self.node, node)
            self.count, self.total, self.square = np.append(self.count, 0.0), np.vstack([self.total, np.zeros(self.dims)]), np.append(self.square, 0.0)
            rest = rest[~near]
        done = np.flatnonzero(target >= 0)
        target = target[done]
        np.add.at(self.count, target, count[done])
        np.add.at(self.total, target, total[done])
        np.add.at(self.square, target, square[done])
        np.add.at(self.node_count, self.node[target], count[done])
        np.add.at(self.node_total, self.node[target], total[done])
        return np.sort(rest)

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"count": self.count, "total": list(self.total), "square": self.square, "radius": self.radius})


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]
    best = d2.argmin(1)
    return best, ((points - centres[best]) ** 2).sum(1)


def ward(count: np.ndarray, centre: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, cost); merge i founds cluster n + i. Nearest-neighbour chains, quadratic; costs never fall from child to parent."""
    n = len(count)
    size, place = np.zeros(2 * n - 1), np.zeros((2 * n - 1, centre.shape[1]))
    size[:n], place[:n] = count, centre
    alive, chain, merges = np.zeros(2 * n - 1, bool), [], []
    alive[:n] = True
    height = np.zeros(2 * n - 1)
    while len(merges) < n - 1:
        if not chain:
            chain = [int(alive.argmax())]
        at = chain[-1]
        others = np.flatnonzero(alive)
        others = others[others != at]
        gap = place[others] - place[at]
        cost = (gap * gap).sum(1) * size[others] * size[at] / (size[others] + size[at])
        low = int(cost.argmin())
        to = int(others[low])
        if len(chain) > 1 and cost[np.searchsorted(others, chain[-2])] <= cost[low]:
            to = chain[-2]
            fresh = n + len(merges)
            height[fresh] = max(float(cost[low]), height[at], height[to])
            merges.append((at, to, float(height[fresh])))
            size[fresh] = size[at] + size[to]
            place[fresh] = (place[at] * size[at] + place[to] * size[to]) / size[fresh]
            alive[[at, to]], alive[fresh] = False, True
            chain = chain[:-2]
        else:
            chain.append(to)
    return merges


def cut_tree(count: np.ndarray, centre: np.ndarray, extent: np.ndarray | None = None, clusters: int | None = None) -> np.ndarray:
    """A cluster number for each leaf entry.

    Without a number of clusters, the cut is the one whose clusters lie furthest apart against their own extent (least
    distance between entries of two clusters over largest distance within one, an entry's own ``extent`` included); every
    number of clusters from 2 to that of the entries is weighed, the latter only if half of the entries hold several
    records. If none lies further apart than it extends, all entries are one cluster. Ties go to fewer clusters.
    """
    n = len(count)
    if n == 1:
        return np.zeros(1, np.int64)
    merges = ward(count, centre)
    order = sorted(range(len(merges)), key=lambda i: (merges[i][2], i))
    if clusters:
        return _labels(n, merges, order[: n - min(clusters, n)])
    gaps = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(2), 0))
    np.fill_diagonal(gaps, np.inf)
    # of clusters alive: least gap to every other cluster, and extent; a merged cluster takes the row of one of its parts
    wide = np.zeros(n) if extent is None else extent.astype(float).copy()
    least, row = gaps.copy(), {i: i for i in range(n)}
    members = {i: np.array([i]) for i in range(n)}
    best, best_score, alive = n, 1.0, n
    low = least.min(1)
    inner = np.where(np.isinf(gaps), 0.0, gaps)
    for step in range(len(order)):
        if step or (count > 1).mean() >= 0.5:
            score = low.min() / max(wide.max(), 1e-9)
            if score > 1 and score >= best_score:
                best, best_score = step, score
        i = order[step]
        a, b = merges[i][:2]
        x, y = row.pop(a), row.pop(b)
        wide[x] = max(wide[x], wide[y], inner[np.ix_(members[x], members[y])].max())
        members[x] = np.concatenate([members[x], members.pop(y)])
        joined = np.minimum(least[x], least[y])
        joined[[x, y]] = np.inf
        least[x], least[:, x] = joined, joined
        least[y], least[:, y] = np.inf, np.inf
        # whoever was nearest to y is now as near to x, so only the rows' least values of x and y change
        low[x], low[y], wide[y] = joined.min(), np.inf, 0.0
        row[n + i] = x
        alive -= 1
    return np.zeros(n, np.int64) if best_score <= 1 else _labels(n, merges, order[:best])


def _labels(n: int, merges: list[tuple[int, int, float]], done: list[int]) -> np.ndarray:
    """Cluster numbers after the named merges, in the order of their first entries."""
    parent = np.arange(2 * n - 1)
    for i in done:
        parent[list(merges[i][:2])] = n + i
    while (parent[parent] != parent).any():
        parent = parent[parent]
    first = np.unique(parent[:n], return_index=True)[1]
    place = {int(parent[at]): k for k, at in enumerate(np.sort(first))}
    return np.array([place[int(p)] for p in parent[:n]])


def feature_leaves(df: DataFrame, group: str, dims: int, cut: Cut) -> DataFrame:
    """(group, count, total, square, radius): leaf entries of one tree per group, from a tree per partition and group, reduced ``FAN_IN`` at a time."""
    kind = df.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, part int, count double, total array<double>, square double, radius double"

    def grown(batches):
        from pyspark import TaskContext

        part, trees = TaskContext.get().partitionId(), {}
        for pdf in batches:
            for key, rows in pdf.groupby(group, dropna=False):
                x = np.vstack(rows["v"].to_numpy())
                trees.setdefault(None if key != key else key, FeatureTree(dims)).insert(np.ones(len(x)), x, (x**2).sum(1))
        for key, tree in trees.items():
            yield tree.frame().assign(**{group: key, "part": part})[[group, "part", "count", "total", "square", "radius"]]

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = FeatureTree(dims, float(pdf["radius"].max()))
        tree.insert(pdf["count"].to_numpy(float), np.vstack(pdf["total"].to_numpy()), pdf["square"].to_numpy(float))
        return tree.frame().assign(**{group: pdf[group].iloc[0], "part": int(pdf["part"].iloc[0]) // FAN_IN})[[group, "part", "count", "total", "square", "radius"]]

    leaves = cut.table(df.select(group, "v").mapInPandas(grown, schema))
    width = (leaves.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        leaves = leaves.groupBy(group, F.floor(F.col("part") / FAN_IN).cast("int").alias("bucket")).applyInPandas(reduced, schema)
        width = -(-width // FAN_IN)
        if width == 1:
            return cut.table(leaves.drop("part"))
        leaves = cut.table(leaves)


def similarity_clusters(df: DataFrame, id_col: str, group: str, num_cols: tuple[str, ...], clusters: int | None = None, typical: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, described): members (id, group, cluster, distance to its centroid); described (group, cluster, n, rep_id, typical ids nearest first).

    Columns are brought to mean 0 and deviation 1 per group; a constant column counts as 0. Rows with a NULL or NaN
    number or a NULL id are left out, repeated ids count once (smallest values), a NULL group is a group. Ties of
    distance go to the smaller id. An empty table gives empty results.
    """
    spark, cut = df.sparkSession, Cut(df.sparkSession)
    values = [F.col(c).cast("double") for c in num_cols]
    usable = F.col(id_col).isNotNull()
    for v in values:
        usable &= v.isNotNull() & ~F.isnan(v)
    rows = df.where(usable).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(F.col(group).alias("g"), *[v.alias(f"v{i}") for i, v in enumerate(values)])).alias("s")).select("id", "s.*")
    rows = cut.table(rows)
    stats = rows.groupBy("g").agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(values)) for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    scaled = [F.coalesce(F.try_divide(F.col(f"v{i}") - F.col(f"m{i}"), F.col(f"d{i}")), F.lit(0.0)) for i in range(len(values))]
    few = stats.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    standard = rows.join((F.broadcast(stats) if few else stats).withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2"))).select("id", "g", F.array(*scaled).alias("v"))
    leaves = feature_leaves(standard, "g", len(values), cut)
    kind = rows.schema["g"].dataType.simpleString()

    def agglomerate(pdf: pd.DataFrame) -> pd.DataFrame:
        count, total = pdf["count"].to_numpy(float), np.vstack(pdf["total"].to_numpy())
        centre = total / count[:, None]
        order = np.lexsort(centre.T[::-1])  # so that clusters are numbered alike whatever order the leaves come in
        pdf, count, centre = pdf.iloc[order], count[order], centre[order]
        extent = 2 * np.sqrt(np.maximum(pdf["square"].to_numpy(float) / count - (centre**2).sum(1), 0))
        label = cut_tree(count, centre, extent, clusters)
        return pd.DataFrame({"g": pdf["g"].to_numpy(), "centre": list(centre), "count": count, "cluster": label})

    named = cut.table(leaves.groupBy("g").applyInPandas(agglomerate, f"g {kind}, centre array<double>, count double, cluster int"))
    groups = [r[0] for r in named.select("g").distinct().sort("g").collect()] if few else None
    assigned = "id long, g " + kind + ", cluster int, distance double"
    if few:
        held = named.toPandas()
        book = []
        for g in groups:
            part = held[held["g"].isna()] if g is None else held[held["g"] == g]
            book.append((g, np.vstack(part["centre"].to_numpy()), part["count"].to_numpy(float), part["cluster"].to_numpy(np.int64)))
        shared = spark.sparkContext.broadcast(book)

        def assign(batches):
            tables = {g: (leaf, label, _centroids(leaf, n, label)) for g, leaf, n, label in shared.value}
            for pdf in batches:
                for key, part in pdf.groupby("g", dropna=False):
                    yield _assigned(part, *tables[None if key != key else key])

        members = standard.mapInPandas(assign, assigned)
    else:

        def assign_group(pdf: pd.DataFrame, leaf: pd.DataFrame) -> pd.DataFrame:
            centre, label = np.vstack(leaf["centre"].to_numpy()), leaf["cluster"].to_numpy(np.int64)
            return _assigned(pdf, centre, label, _centroids(centre, leaf["count"].to_numpy(float), label))

        sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")).withColumnRenamed("g", "g2")
        same = F.col("g").eqNullSafe(F.col("g2"))
        parted = standard.join(sizes, same).drop("g2").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        copies = named.join(sizes, same).drop("g2").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        members = parted.groupBy("g", "part").cogroup(copies.groupBy("g", "part")).applyInPandas(assign_group, assigned)
    members = cut.table(members)
    sizes = members.groupBy("g", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep_id"))
    # rows beyond the wanted rank are dropped within their partition, before any shuffle
    rank = F.row_number().over(Window.partitionBy("g", "cluster").orderBy("distance", "id"))
    near = members.withColumn("k", rank).where(F.col("k") <= typical).groupBy(F.col("g").alias("g2"), F.col("cluster").alias("c2")).agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("near"))
    described = sizes.join(near, F.col("g").eqNullSafe(F.col("g2")) & (F.col("cluster") == F.col("c2"))).select("g", "cluster", "n", "rep_id", F.transform("near", lambda s: s["id"]).alias("typical"))
    return members, cut.table(described)


def _centroids(leaf: np.ndarray, count: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.array([np.average(leaf[label == c], axis=0, weights=count[label == c]) for c in range(label.max() + 1)])


def _assigned(part: pd.DataFrame, leaf: np.ndarray, label: np.ndarray, centroids: np.ndarray) -> pd.DataFrame:
    x = np.vstack(part["v"].to_numpy())
    cluster = label[_nearest(x, leaf)[0]]
    return pd.DataFrame({"id": part["id"].to_numpy(), "g": part["g"].to_numpy(), "cluster": cluster, "distance": np.sqrt(((x - centroids[cluster]) ** 2).sum(1))})


def _run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return similarity_clusters(table(spark, folder, "synapse_features"), "synapse_id", "genotype", NUM_COLS)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    members, described = _run(spark, folder)
    reps = described.select(F.col("g").alias("g2"), F.col("cluster").alias("c2"), "rep_id")
    return members.join(reps, F.col("g").eqNullSafe(F.col("g2")) & (F.col("cluster") == F.col("c2"))).select("rep_id", F.col("id").alias("synapse_id"))


def p7_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder)[1].select(F.col("g").alias("genotype"), "rep_id", "n", "typical")


QUERIES = {"p7_found": p7_found, "p7_clusters": p7_clusters}
_C = ", ".join(f"(avg({c}) OVER g) AS m{i}, (stddev_pop({c}) OVER g) AS d{i}" for i, c in enumerate(NUM_COLS))
#: Groups that lie further apart than they extend, by all pairs: distances leave a gap between the largest within and the least between.
_GROUPS = f"""WITH r AS (SELECT DISTINCT synapse_id, genotype, {", ".join(NUM_COLS)} FROM synapse_features WHERE synapse_id IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in NUM_COLS)}),
s AS (SELECT synapse_id AS id, coalesce(genotype, '') AS g, {", ".join(f"coalesce(({c} - m{i}) / nullif(d{i}, 0), 0) AS v{i}" for i, c in enumerate(NUM_COLS))} FROM (SELECT *, {_C} FROM r WINDOW g AS (PARTITION BY genotype))),
p AS (SELECT a.g, a.id AS a, b.id AS b, sqrt({" + ".join(f"pow(a.v{i} - b.v{i}, 2)" for i in range(len(NUM_COLS)))}) AS d FROM s a JOIN s b USING (g)),
q AS (SELECT g, d, lag(d) OVER (PARTITION BY g ORDER BY d) AS below FROM p WHERE a < b AND d > 0.2), t AS (SELECT g, arg_max((d + below) / 2, d / below) AS reach FROM q WHERE below IS NOT NULL GROUP BY g),
c AS (SELECT p.g, p.a AS synapse_id, min(p.b) AS rep_id FROM p JOIN t USING (g) WHERE p.d <= t.reach GROUP BY ALL)"""
SQL = {"p7_found": f"{_GROUPS} SELECT rep_id, synapse_id FROM c"}
