"""Problem 4: the region trees from parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from morphoquarry.operators.hierarchy import closure, hierarchy
from morphoquarry.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(table(spark, folder, "ontology"), "id", "parent_structure_id").select("id", "state", "root_id", "depth", "path", "n_descendants")


def p4_acronym_paths(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(table(spark, folder, "ontology"), "id", "parent_structure_id", "acronym").where("state = 'tree'").select("id", "depth", "names")


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return closure(hierarchy(table(spark, folder, "ontology"), "id", "parent_structure_id"))


_TREE = """WITH RECURSIVE node AS (SELECT id, min(parent_structure_id) AS up, min(acronym) AS acronym FROM ontology GROUP BY id),
link AS (SELECT n.id, p.id AS parent, n.acronym FROM node n LEFT JOIN node p ON n.up = p.id),
tree AS (SELECT id, id AS root_id, 1 AS depth, '/' || id || '/' AS path, '/' || acronym || '/' AS names, [id] AS ids FROM link WHERE parent IS NULL
  UNION ALL SELECT l.id, t.root_id, t.depth + 1, t.path || l.id || '/', t.names || l.acronym || '/', list_append(t.ids, l.id) FROM link l JOIN tree t ON l.parent = t.id)"""
QUERIES = {"p4_found": p4_found, "p4_acronym_paths": p4_acronym_paths, "p4_descendants": p4_descendants}
SQL = {
    "p4_found": f"""{_TREE},
up AS (SELECT l.id AS origin, l.parent AS cur, 1 AS n FROM link l WHERE l.parent IS NOT NULL AND l.id NOT IN (SELECT id FROM tree)
  UNION ALL SELECT u.origin, l.parent, u.n + 1 FROM up u JOIN link l ON u.cur = l.id WHERE u.n < 200 AND u.cur <> u.origin),
loops AS (SELECT DISTINCT origin FROM up WHERE cur = origin),
below AS (SELECT i AS id, count(*) - 1 AS n FROM (SELECT unnest(ids) AS i FROM tree) GROUP BY i)
SELECT l.id, CASE WHEN t.id IS NOT NULL THEN 'tree' WHEN c.origin IS NOT NULL THEN 'cycle' ELSE 'below_cycle' END AS state,
  coalesce(t.root_id, -1) AS root_id, CAST(coalesce(t.depth, -1) AS BIGINT) AS depth, coalesce(t.path, '') AS path, CAST(coalesce(b.n, -1) AS BIGINT) AS n_descendants
FROM link l LEFT JOIN tree t USING (id) LEFT JOIN loops c ON c.origin = l.id LEFT JOIN below b ON b.id = l.id""",
    "p4_acronym_paths": f"{_TREE} SELECT id, CAST(depth AS BIGINT) AS depth, names FROM tree",
    "p4_descendants": f"{_TREE} SELECT a AS ancestor, id AS descendant, CAST(depth - list_position(ids, a) AS BIGINT) AS steps FROM (SELECT id, depth, ids, unnest(ids) AS a FROM tree)",
}
