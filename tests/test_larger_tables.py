"""Queries against their SQL where the smallest tables don't reach."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import ball
from pitchlake.operators.lineage import saved
from pitchlake.plans import catalog


def _same(spark, path, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    df, out = catalog.queries()[name](spark, str(path)), con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    theirs = sorted((tuple(r[out.columns.index(c)] for c in cols) for r in out.fetchall()), key=repr)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr), theirs


@pytest.mark.parametrize(("name", "first", "n"), [("clock", 240_000, 2_000), ("weighted_quantile_by_match", 0, 20_000)])
def test_late_minutes_and_matches_without_people(spark, tmp_path, name, first, n):
    """Minutes of three digits; a match that has balls but no people has no quantile."""
    duckdb.sql(f"copy (select {first} + range as event_id, (range % 97)::double as value from range({n})) to '{tmp_path}/events.parquet'")
    ours, theirs = _same(spark, tmp_path, name)
    assert ours and ours == theirs


def test_what_is_saved_takes_no_conditions_along(spark):
    """Conditions that the optimizer keeps from round to round double in a loop, all on the driver."""
    df = saved(spark.range(10).withColumn("b", F.col("id") + 1).where("b = id + 1 and b > 2"))
    assert df._jdf.queryExecution().analyzed().constraints().size() == 0
    assert sorted(df.collect()) == [(i, i + 1) for i in range(2, 10)]


def test_objects_out_of_reach_are_not_looked_at_again(spark):
    """40,000 objects one after another: looking at all earlier ones would take 800 million comparisons."""
    n = 40_000
    cands = spark.range(n).select((F.col("id") * 40).cast("int").alias("frame"), F.lit(0).alias("cand_idx"), F.lit(5.0).alias("mx"), F.lit(5.0).alias("my"))
    began = time.monotonic()
    got = ball.group_objects(cands).agg(F.countDistinct("object"), F.max("object")).first()
    assert tuple(got) == (n, n - 1)
    assert time.monotonic() - began < 30


def test_boxes_of_many_frames_are_merged_in_ranges(spark):
    """8,000 frames with a box of the image and two of tiles, the first of which lies on it; a group for each frame took most of a minute."""
    box = lambda i, x: spark.range(8_000).select(F.col("id").cast("int").alias("frame"), F.lit(i).alias("box_idx"), F.lit(x).alias("x1"), F.lit(0.0).alias("y1"), F.lit(x + 10).alias("x2"), F.lit(20.0).alias("y2"))
    began = time.monotonic()
    got = ball.merge_boxes(box(0, 0.0), box(1, 1.0).unionByName(box(2, 50.0))).groupBy("tile", "box_idx").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 8_000), (1, 2, 8_000)]
    assert time.monotonic() - began < 20
