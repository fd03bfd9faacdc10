"""Each query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from graphloom import queries

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, PATH)
    want = duck.sql(queries.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_paths_plan_as_semi_joins(spark):
    plan = queries.QUERIES["path_multi_step"](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") == 4 and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
