"""Operators for training data. Nothing outside this subpackage imports it."""

from __future__ import annotations

from morphoquarry.llm import clusters, leakage, packing, percentiles, subjects

_PARTS = (percentiles, clusters, packing, leakage, subjects)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in getattr(part, "SQL", {}).items()}
