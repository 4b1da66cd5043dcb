"""Operators that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    order = sorted(x[0] for x in found.description)
    at = [[x[0] for x in found.description].index(c) for c in order]
    want = sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == want
