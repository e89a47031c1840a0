"""Every core query with SQL against DuckDB on the smallest tables, and every core query's schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from morphoquarry import plans  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
MODULES = [entry.importlib.import_module(f"morphoquarry.plans.{name}") for name in entry.PLANS]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: q for m in MODULES for n, q in m.SQL.items()}


def rows(frame):
    def plain(v):
        if v is None or v is getattr(__import__("pandas"), "NA") or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return f"{float(v):.6g}"

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)
