"""Every query with SQL gives DuckDB's rows; the others give rows."""

import os

import duckdb
import pytest

from pitchlake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Empty on so small an input.
EMPTY = {"appearance_cuts", "stitch_global"}
#: Links between tracklets need more frames than the smallest tables have.
LARGER = {"stitch_global_by_match", "stitch_greedy_by_match"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA.replace("sf0.001", "sf0.01") if name in LARGER else DATA)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert rows or name in EMPTY
        return
    out = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(out.columns)
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in rows), key=repr)
    theirs = sorted((tuple(r[out.columns.index(c)] for c in cols) for r in out.fetchall()), key=repr)
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
