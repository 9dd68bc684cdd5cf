"""Every query against its SQL on the smallest tables."""

import os

import pytest

from greffe.plans import catalogue, records  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SF)
    sql = tables.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    assert {c: TYPES[str(t)] for c, t in zip(sql.columns, sql.types)} == dict(df.dtypes)
    rows = lambda found: sorted(found, key=repr)
    at = [sql.columns.index(c) for c in columns]
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(tuple(r[i] for i in at) for r in sql.fetchall())
