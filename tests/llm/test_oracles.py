"""Queries whose rows SQL can express, against DuckDB on whole small tables."""

import os

import duckdb
import pytest

from pitchlake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    out = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA).select(*out.columns)
    assert sorted(map(tuple, df.collect())) == sorted(out.fetchall())


def test_names():
    assert [sum(q.startswith(f"op{n}_") for q in queries.queries()) for n in range(1, 14)] == [1] * 13
    assert set(queries.oracle_sql()) <= set(queries.queries())
