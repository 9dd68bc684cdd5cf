"""The operators' queries against their SQL on the smallest tables."""

import os

import pytest

from greffe.llm import queries

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


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, tables, name):
    df = queries.queries()[name](spark, SF)
    sql = tables.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    assert {c: TYPES[str(t)] for c, t in zip(sql.columns, sql.types)} == dict(df.dtypes)
    at = [sql.columns.index(c) for c in columns]
    rows = lambda found: sorted(found, key=repr)
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(tuple(r[i] for i in at) for r in sql.fetchall())


def test_mined_rules_decide_pages(spark, tables):
    """The query's verdicts come from rules that were mined, where no listed rule fits."""
    found = {(r.rule is None, r.verdict, r.mined_rule is None) for r in queries.op8_url_rules(spark, SF).collect()}
    assert (True, "block", False) in found and not any(mined is False and listed is False for listed, _, mined in found)
