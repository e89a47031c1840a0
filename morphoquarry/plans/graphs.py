"""Networks of correlated regions, components, and learned groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators import graph as g
from morphoquarry.operators import learn as l
from morphoquarry.operators import painted
from morphoquarry.operators.filters import top_per_key
from morphoquarry.operators.twostage import stable
from morphoquarry.plans.aggregates import COARSE, Grid, polygons
from morphoquarry.plans.stats import _PAIRS_SQL, FEATURES, SYN_SQL, _pairs, _synapses
from morphoquarry.sources.tables import OBJECTS_SQL, table

QUERIES, SQL = {}, {}
R = 0.2
EDGES_SQL = f"(SELECT treatment, region_a AS src, region_b AS dst, r AS weight FROM {_PAIRS_SQL} WHERE abs(r) >= {R})".replace("{OBJ}", OBJECTS_SQL)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.replace("{E}", EDGES_SQL).replace("{SYN}", SYN_SQL).replace("{OBJ}", OBJECTS_SQL)
        return fn

    return add


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return stable(g.threshold_edges(_pairs(spark, d), "region_a", "region_b", "r", R).select("treatment", "src", "dst", "weight"))


@query("SELECT treatment, src, dst, round(weight, 6) AS weight FROM {E}")
def corr_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).withColumn("weight", F.round("weight", 6))


@query("SELECT treatment, node, count(*) AS degree, round(sum(weight), 6) AS strength, round(sum(abs(weight)), 6) AS abs_strength FROM (SELECT treatment, src AS node, weight FROM {E} UNION ALL SELECT treatment, dst, weight FROM {E}) GROUP BY ALL")
def node_degree_strength(spark: SparkSession, d: str) -> DataFrame:
    out = g.degrees(_edges(spark, d), ["treatment"])
    return out.withColumns({c: F.round(c, 6) for c in ("strength", "abs_strength")})


@query("""WITH u AS (SELECT treatment, src AS a, dst AS b FROM {E} UNION ALL SELECT treatment, dst, src FROM {E}), k AS (SELECT treatment, a AS node, count(*) AS degree FROM u GROUP BY ALL),
t AS (SELECT x.treatment, x.a AS node, count(*) / 2 AS triangles FROM u x JOIN u y ON y.treatment = x.treatment AND y.a = x.b JOIN u z ON z.treatment = y.treatment AND z.a = y.b AND z.b = x.a GROUP BY ALL)
SELECT k.treatment, k.node, degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles, round(CASE WHEN degree < 2 THEN 0 ELSE 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) END, 9) AS clustering FROM k LEFT JOIN t ON t.treatment = k.treatment AND t.node = k.node""")
def triangle_clustering(spark: SparkSession, d: str) -> DataFrame:
    return g.clustering(_edges(spark, d), ["treatment"]).withColumn("clustering", F.round("clustering", 9))


@query("SELECT treatment, count(DISTINCT node) AS nodes, CAST(count(*) / 2 AS BIGINT) AS edges, round(CAST(count(*) AS DOUBLE) / (count(DISTINCT node) * (count(DISTINCT node) - 1)), 9) AS density FROM (SELECT treatment, src AS node FROM {E} UNION ALL SELECT treatment, dst FROM {E}) GROUP BY treatment")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return g.density(_edges(spark, d), ["treatment"]).withColumn("density", F.round("density", 9))


@query()
def network_measures(spark: SparkSession, d: str) -> DataFrame:
    return g.network_measures(_edges(spark, d), "treatment")


@query()
def node_measures(spark: SparkSession, d: str) -> DataFrame:
    return g.node_measures(_edges(spark, d), "treatment")


@query("""WITH RECURSIVE n AS (SELECT id, min(parent_structure_id) AS up FROM ontology GROUP BY id), e AS (SELECT n.id AS a, n.up AS b FROM n JOIN n p ON p.id = n.up UNION SELECT n.up, n.id FROM n JOIN n p ON p.id = n.up),
r AS (SELECT id, id AS reach FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach) SELECT id, min(reach) AS component FROM r GROUP BY id""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "ontology").groupBy("id").agg(F.min("parent_structure_id").alias("up"))
    links = n.join(n.select(F.col("id").alias("up")), "up").select(F.col("id").alias("src"), F.col("up").alias("dst"))
    return g.connected_components(links, n.select("id"))


@query()
def label_components(spark: SparkSession, d: str, grid: Grid = COARSE) -> DataFrame:
    """Labels of an example that fall into several parts of touching places: as many rows as parts."""

    def parts(s: painted.Shapes) -> dict:
        labels, plane = np.unique(np.stack([s.image, s.number], 1), axis=0, return_inverse=True)
        runs = s.apart(plane.ravel(), len(labels))
        part, which = np.unique(painted.touching(runs), return_inverse=True)
        area = np.bincount(which, runs.hi - runs.lo + 1, len(part)).astype(np.int64)
        of = labels[runs.id[part]]
        return {"ex_i": s.names.take(of[:, 0]), "label": painted.numbers(of[:, 1]), "area": area}

    return painted.by_image(polygons(spark, d), "ex_i", "label", "ring", "holes" if grid.holes else None, grid.pitch, parts, "ex_i string, label long, area long")


@query("SELECT synapse_id, CAST(genotype = 'HET' AS INT) AS genotype_HET, CAST(genotype = 'KO' AS INT) AS genotype_KO, CAST(genotype = 'WT' AS INT) AS genotype_WT FROM {SYN}")
def one_hot_encode(spark: SparkSession, d: str) -> DataFrame:
    return l.one_hot(_synapses(spark, d).select("synapse_id", "genotype"), "genotype").drop("genotype")


@query("SELECT synapse_id, round((area - avg(area) OVER p) / stddev_pop(area) OVER p, 6) AS area FROM {SYN} WINDOW p AS (PARTITION BY genotype)")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    return l.standard_scaled(_synapses(spark, d).select("synapse_id", "genotype", "area"), ["area"], ["genotype"]).select("synapse_id", F.round("area", 6).alias("area"))


@query("SELECT synapse_id, round((area - median(area) OVER ()) / (quantile_cont(area, 0.75) OVER () - quantile_cont(area, 0.25) OVER ()), 6) AS area FROM {SYN}")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return l.robust_scaled(_synapses(spark, d).select("synapse_id", "area"), ["area"]).withColumn("area", F.round("area", 6))


@query()
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    rows = l.standard_scaled(_synapses(spark, d).dropna(subset=FEATURES), FEATURES)
    return l.principal_components(rows, FEATURES, 0.95)[0].drop(*FEATURES)


@query()
def kmeans_within_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = l.standard_scaled(_synapses(spark, d).dropna(subset=FEATURES), FEATURES, ["genotype"])
    return l.within_groups(rows, "genotype", lambda part: l.kmeans(part, FEATURES, 3)[0]).select("synapse_id", "genotype", "cluster", F.round("score", 6).alias("score"))


@query()
def clara_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = l.standard_scaled(_synapses(spark, d).dropna(subset=FEATURES), FEATURES)
    return l.clara(rows, FEATURES, 4, "synapse_id")[0].select("synapse_id", "cluster", F.round("score", 6).alias("score"))


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    return l.permutation_importance(_synapses(spark, d).dropna(subset=FEATURES), FEATURES, "genotype", "synapse_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 5) AS euclidean, round(list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))), 5) AS manhattan FROM embeddings")
def array_distance(spark: SparkSession, d: str) -> DataFrame:
    from morphoquarry.operators.reshape import distance

    zero = F.array_repeat(F.lit(0.0), 64)
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(distance(e, zero), 5).alias("euclidean"), F.round(distance(e, zero, "manhattan"), 5).alias("manhattan"))


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 10")
def top_lines(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]]
    return top_per_key(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], order, 10).select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
