"""Registered queries against their SQL on the small tables, where these are present."""

import os

import duckdb
import pytest

from caseloom.plans import all_queries as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def canonical(x):
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(canonical, x)) + "]"
    if x is None or (isinstance(x, float) and x != x):
        return "NULL"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(canonical(tuple(r)) for r in frame.select(*columns).collect())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    sql = queries.ORACLE_SQL.get(name)
    if sql is None:
        return
    cursor = duck.execute(f"SELECT * FROM ({sql}) q")
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(canonical(tuple(r[i] for i in order)) for r in cursor.fetchall())
