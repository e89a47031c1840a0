"""Encoders, scalers, clusterers and their interpretation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators.twostage import with_percentiles

#: Rows that k-medoids are fitted on, and repeats; the whole table is assigned.
CLARA_SAMPLE, CLARA_REPEATS = 100_000, 5
#: Rows whose distances to each other are held at once; beyond them they are made in tiles, again for each step.
PAM_ROWS, PAM_TILE = 2_000, 2_000_000
#: Points of a cell, which are weighed as one first.
PAM_CELL = 24
#: Trees of the forest, and shuffles of each feature.
TREES, SHUFFLES = 400, 15
#: Most categories of a column that is one-hot encoded; they become columns.
CATEGORIES = 1_000


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """Adds a 0/1 column per value, in order; NULL is 0 in all. Raises ValueError beyond 1000 values."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(CATEGORIES + 1).collect()]
    if len(found) > CATEGORIES:
        raise ValueError(f"{column} has over {CATEGORIES} values")
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in sorted(found)})


def _wide(df: DataFrame, features: list[str], keys: list[str], aggregates: dict[str, object]) -> DataFrame:
    stats = df.groupBy(*keys).agg(*[fn(f).alias(f"_{n}_{f}") for f in features for n, fn in aggregates.items()])
    if not keys:
        one = stats.first()
        return df.withColumns({f"_{n}_{f}": F.lit(one[f"_{n}_{f}"]).cast("double") for f in features for n in aggregates})
    renamed = stats.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    return df.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def standard_scaled(df: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Features at mean 0 and population deviation 1, per key if given; a constant feature becomes 0."""
    w = _wide(df, features, keys, {"m": F.avg, "d": F.stddev_pop})
    scaled = {f: F.when(F.col(f).isNotNull(), F.coalesce(F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_d_{f}")), F.lit(0.0))) for f in features}
    return w.withColumns(scaled).drop(*[f"_{n}_{f}" for f in features for n in "md"])


def robust_scaled(df: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Features less their median over the range from the first to the third quartile (interpolated); 0 where that range is 0."""
    out = df
    for f in features:
        q = F.col("_q")
        scaled = F.coalesce(F.try_divide(F.col(f) - q[1], q[2] - q[0]), F.lit(0.0))
        out = with_percentiles(out, keys, f, [0.25, 0.5, 0.75], "_q").withColumn(f, F.when(F.col(f).isNotNull(), scaled)).drop("_q")
    return out


def principal_components(df: DataFrame, features: list[str], keep: int | float) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with pc1…, components, explained shares): a number of components, or as many as explain a share of the variance.

    The covariances come from one pass over all rows; the sign makes each component's largest entry positive.
    """
    from morphoquarry.operators.stats import gram

    rows = df.dropna(subset=features)
    means = rows.agg(*[F.avg(f).alias(f) for f in features]).first()
    centred = rows.withColumns({f"_c_{f}": F.col(f) - F.lit(means[f] or 0.0) for f in features})
    n, products = gram(centred, [f"_c_{f}" for f in features])
    values, vectors = np.linalg.eigh(products / max(n - 1, 1))
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    shares = values / values.sum() if values.sum() > 0 else values
    count = keep if isinstance(keep, int) else int(np.searchsorted(np.cumsum(shares), keep - 1e-12)) + 1
    count = min(count, len(features))
    out = centred.withColumns({f"pc{i + 1}": sum((F.col(f"_c_{f}") * float(v) for f, v in zip(features, vectors[i])), F.lit(0.0)) for i in range(count)})
    return out.drop(*[f"_c_{f}" for f in features]), vectors[:count], shares[:count]


def squared_distance(features: list[str], centre) -> Column:
    return sum(((F.col(f) - float(c)) * (F.col(f) - float(c)) for f, c in zip(features, centre)), F.lit(0.0))


def assign_nearest(df: DataFrame, features: list[str], centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """Adds the nearest centre's number (ties: the smaller) and ``score`` 1 / (1 + distance), in the JVM."""
    best = F.array_min(F.array(*[F.struct(squared_distance(features, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    return df.withColumn("_mq_b", best).withColumns({out: F.col("_mq_b.i"), "score": 1 / (1 + F.sqrt("_mq_b.d"))}).drop("_mq_b")


def kmeans(df: DataFrame, features: list[str], k: int, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Adds cluster and score by k-means (parallel k-means++ start); centres in order of their coordinates."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = df.dropna(subset=features)
    model = KMeans(k=k, seed=seed, featuresCol="_mq_v").fit(VectorAssembler(inputCols=features, outputCol="_mq_v").transform(rows).select("_mq_v"))
    centres = np.array(sorted(tuple(map(float, c)) for c in model.clusterCenters()))
    return assign_nearest(rows, features, centres), centres


def pam(points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Medoid numbers by greedy building and best swaps, over all distances of a bounded sample."""
    d = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(2), 0))
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < min(k, len(points)):
        gain = np.maximum(d[:, medoids].min(1)[:, None] - d, 0).sum(0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    for _ in range(rounds):
        cost, best = d[:, medoids].min(1).sum(), None
        for i in range(len(medoids)):
            rest = d[:, [m for j, m in enumerate(medoids) if j != i]].min(1) if len(medoids) > 1 else np.full(len(points), np.inf)
            totals = np.minimum(rest[:, None], d).sum(0)
            at = int(totals.argmin())
            if totals[at] < cost - 1e-12:
                cost, best = totals[at], (i, at)
        if best is None:
            break
        medoids[best[0]] = best[1]
    return np.array(sorted(medoids))


def _cells(points: np.ndarray) -> list[np.ndarray]:
    """Numbers of points in cells of at most ``PAM_CELL``, halved along their longest side."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= PAM_CELL:
            out.append(at)
            continue
        side = points[at].T[np.ptp(points[at], axis=0).argmax()]
        order = np.argpartition(side, len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def pam_tiled(spark: SparkSession, points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """``pam`` without holding the distances: every step weighs points as medoids, in tiles spread over the tasks.

    Totals grow with every distance, and no point of a cell is nearer to any other than the cell's middle less its
    radius. So a step weighs the cells first, and then the points of those that can hold the best one.
    """
    n = len(points)
    points = points - points.mean(0)
    k, rows = min(k, n), max(1, PAM_TILE // n)
    sent = spark.sparkContext.broadcast(points)

    def distances(x: np.ndarray, at) -> np.ndarray:
        d = np.add.outer((x[at] ** 2).sum(1), (x**2).sum(1)) - 2 * (x[at] @ x.T)
        return np.sqrt(np.maximum(d, 0, out=d), out=d)

    def weighed(fn, at: np.ndarray, radius: np.ndarray | None = None) -> np.ndarray:
        """``fn(distances of a tile)``, rows by point, of the points ``at``; with radii, ``fn`` of the distances and of the least ones side by side."""
        tasks = max(1, min(len(at), 4 * spark.sparkContext.defaultParallelism))

        def run(batches):
            x = sent.value
            for pdf in batches:
                for t in pdf["id"]:
                    ids = np.arange(len(at) * t // tasks, len(at) * (t + 1) // tasks)
                    for i in range(0, len(ids), rows):
                        one = ids[i : i + rows]
                        d = distances(x, at[one])
                        v = fn(d) if radius is None else np.hstack([fn(d), fn(np.maximum(d - radius[one, None], 0))])
                        yield pd.DataFrame({"at": one, "v": list(v)})

        got = spark.range(tasks, numPartitions=tasks).mapInPandas(run, "at long, v array<double>").toPandas().sort_values("at")
        return np.array(got["v"].tolist())

    cells = _cells(points)
    middle = np.array([c[((points[c] - points[c].mean(0)) ** 2).sum(1).argmin()] for c in cells])
    # rounding of the distances must not hide a point
    radius = np.array([np.sqrt(((points[c] - points[m]) ** 2).sum(1).max()) for c, m in zip(cells, middle)]) + 1e-6 * np.abs(points).max()

    def best(totals, taken: list[int]) -> tuple[float, int, int]:
        """(least total, point, column), the first of equals; points that are taken are left out."""
        v = weighed(totals, middle, radius)
        wide = v.shape[1] // 2
        free = ~np.isin(middle, taken)
        bound = v[free, :wide].min() if free.any() else np.inf
        held = v[:, wide:].min(1) <= bound * (1 + 1e-9)
        at = np.sort(np.concatenate([c for c, keep in zip(cells, held) if keep]))
        at = at[~np.isin(at, taken)]
        cost = weighed(totals, at)
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        return float(cost[i, j]), int(at[i]), int(j)

    medoids = [best(lambda d: d.sum(1)[:, None], [])[1]]
    while len(medoids) < k:
        nearest = distances(points, medoids).min(0)
        medoids.append(best(lambda d: np.minimum(nearest, d).sum(1)[:, None], medoids)[1])
    for _ in range(rounds):
        near = distances(points, medoids)
        own, first = near.argmin(0), near.min(0)
        near[own, np.arange(n)] = np.inf
        second, mine = near.min(0), np.eye(k)[own]

        def totals(d: np.ndarray) -> np.ndarray:
            kept = np.minimum(d, first)
            return kept.sum(1)[:, None] + (np.minimum(d, second) - kept) @ mine

        cost, at, i = best(totals, [])
        if not cost < first.sum() * (1 - 1e-12):
            break
        medoids[i] = at
    sent.unpersist()
    return np.array(sorted(medoids))


def clara(df: DataFrame, features: list[str], k: int, order: str, seed: int = 1, sample: int = CLARA_SAMPLE, repeats: int = CLARA_REPEATS) -> tuple[DataFrame, np.ndarray]:
    """Adds cluster and score by k-medoids: fitted on bounded samples, the medoids of least total distance over the whole table kept."""
    rows = df.dropna(subset=features)
    best, best_cost = None, None
    for i in range(repeats):
        draw = rows.orderBy(F.xxhash64(F.lit(seed + i), F.col(order)), order).limit(sample).select(*features).toPandas().to_numpy(float)
        if not len(draw):
            return rows.withColumns({"cluster": F.lit(0), "score": F.lit(0.0)}), np.zeros((0, len(features)))
        centres = draw[pam(draw, k) if len(draw) <= PAM_ROWS else pam_tiled(df.sparkSession, draw, k)]
        centres = centres[np.lexsort(centres.T[::-1])]
        cost = assign_nearest(rows, features, centres).agg(F.sum(1 / F.col("score") - 1)).first()[0]
        if best_cost is None or cost < best_cost:
            best, best_cost = centres, cost
    return assign_nearest(rows, features, best), best


def within_groups(df: DataFrame, group: str, fit) -> DataFrame:
    """One fit per group, NULL included, joined by name; ``fit`` takes and returns a DataFrame. For few groups: each is a plan of its own."""
    parts = [fit(df.where(F.col(group).eqNullSafe(F.lit(g)))) for g in sorted((r[0] for r in df.select(group).distinct().collect()), key=lambda v: (v is not None, v))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def permutation_importance(df: DataFrame, features: list[str], label: str, order: str, seed: int = 1, trees: int = TREES, shuffles: int = SHUFFLES) -> DataFrame:
    """(feature, importance): how much of a random forest's accuracy a feature's shuffling costs, on average over the shuffles."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    from morphoquarry.operators.windows import shuffled_within

    rows = StringIndexer(inputCol=label, outputCol="_mq_y").fit(df).transform(df.dropna(subset=[*features, label]))
    vector = VectorAssembler(inputCols=features, outputCol="_mq_v")
    model = RandomForestClassifier(featuresCol="_mq_v", labelCol="_mq_y", numTrees=trees, seed=seed).fit(vector.transform(rows))
    right = lambda d: model.transform(vector.transform(d)).agg(F.avg((F.col("prediction") == F.col("_mq_y")).cast("double"))).first()[0] or 0.0
    whole, out = right(rows), []
    ranged = rows.withColumn("_mq_g", F.pmod(F.xxhash64(F.col(order)), F.lit(64))).withColumn("_mq_s", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
    for f in features:
        mixed = shuffled_within(ranged, f, ["_mq_g", "_mq_s"], [order, "_mq_s"], seed, "_mq_f").withColumn(f, F.col("_mq_f"))
        out.append((f, float(whole - right(mixed))))
    return df.sparkSession.createDataFrame(out, "feature string, importance double")


def describe_components(components: np.ndarray, features: list[str], centres: np.ndarray) -> pd.DataFrame:
    """Centres in component space back in feature space."""
    return pd.DataFrame(centres @ components, columns=features)
