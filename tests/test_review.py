"""Profiles, reviews, many matches; and that the order of rows never matters."""

import os

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import filters, islands, metrics, review, smoothing, teams, tracking
from pitchlake.plans import fixtures, matches, profiles

from .test_operators import detections, gt, positions, track

DATA = "/root/testdata/sf0.001"


def test_profiles_keep_a_lone_runner(spark):
    d = detections(spark, [(3 * i, 0, 0.3 * i, 5) for i in range(20) if i not in (8, 9)])
    for name in profiles.PROFILES:
        got = profiles.run(d, profiles.Profile(name))
        assert got.count() == 20 - 2 * (name == "bytetrack") or got.where("es_real = 1").count() == 18
        assert got.select("id_jugador").distinct().count() == 1


def test_profiles_differ_in_repair(spark):
    rows = positions(spark, [(3 * i, 1, 0, "A", (0 if i < 6 else 60) + 0.1 * i, 0, 1) for i in range(12)])
    frames = rows.select("frame", "tiempo_s")
    cut = profiles.finished(rows, frames, profiles.Profile("candidato", smooth=3))
    whole = profiles.finished(rows, frames, profiles.Profile("bytetrack"))
    assert cut.select("id_jugador").distinct().count() > 1 and whole.select("id_jugador").distinct().count() == 1


def test_lifting_keeps_matches_apart(spark):
    one = positions(spark, [(f, i, 0, "A", 10 * i + f, 5, 1) for f in range(0, 9, 3) for i in (1, 2)])
    two = one.withColumn("match_no", F.lit(0)).unionByName(one.withColumn("match_no", F.lit(1)))
    up = matches.lifted(two)
    assert islands.pair_overlap(up).count() == 2 and islands.speeds(up).count() == 2 * islands.speeds(one).count()
    assert matches.lowered(up).select(*two.columns).exceptAll(two).count() == 0


def test_worst_windows_do_not_overlap(spark):
    rows = positions(spark, [(f, i, 0, "A", 1, 1, 1) for f in range(0, 5000, 25) for i in range(1 + (f // 1000))])
    got = sorted(r["start_s"] for r in review.worst_windows(rows, 3, 30, 5).collect())
    assert len(got) == 3 and all(b - a >= 30 for a, b in zip(got, got[1:], strict=False))


def test_flights_must_return(spark):
    t = track(spark, [(i, 0) for i in range(8)]).withColumn("aerial", F.col("frame").isin(4, 6, 14))
    got = {r["frame"] for r in review.readmitted_flights(t).where("readmitted").collect()}
    assert got == {4, 6}


def test_oracle_takes_the_truth(spark):
    g = gt(spark, [(0, 1, 5, 5, "A")])
    rows = gt(spark, [(0, 9, 6, 5, "B"), (0, 8, 50, 5, "B")])
    pairs = spark.createDataFrame([(0, 1, 9, 1.0)], "frame int, gt_id int, pred_id int, distance double")
    assert {(r["obj_id"], r["x_m"]) for r in review.oracle(rows, g, pairs, "position").collect()} == {(9, 5.0), (8, 50.0)}
    assert {(r["obj_id"], r["team"]) for r in review.oracle(rows, g, pairs, "team").collect()} == {(9, "A"), (8, "B")}
    assert {r["obj_id"] for r in review.oracle(rows, g, pairs, "identity").collect()} == {1, 8}


def test_catalogue():
    assert review.missing_calculators({"a": True, "b": False, "c": True}, {"a"}) == ["c"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(
    "operator",
    [metrics.lines, metrics.territory, metrics.deepest, smoothing.visual_hysteresis, smoothing.spread_labels, smoothing.cut_by_speed, islands.fast_runs, filters.credible, teams.last_men, teams.staff, metrics.label_mode],
    ids=lambda f: f.__name__,
)
def test_order_of_rows_does_not_matter(spark, operator):
    p = fixtures.table(spark, DATA, "positions")
    shuffled = p.repartition(7, F.xxhash64("frame", "id_jugador")).sortWithinPartitions(F.xxhash64("x_m"))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(operator(p)) == key(operator(shuffled))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_tracker_does_not_depend_on_partitions(spark):
    d = fixtures.table(spark, DATA, "detections")
    a, b = tracking.conservative_tracker(d, 0.12), tracking.conservative_tracker(d.repartition(5), 0.12)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_plans_have_no_nested_loops(spark):
    p, b = fixtures.table(spark, DATA, "positions"), fixtures.table(spark, DATA, "ball_cand")
    times = p.select("frame", "tiempo_s").distinct()
    for df in (
        smoothing.fill_gaps(p, times, 0.5), islands.nearest_in_time(b, times, 0.1, "t", "tiempo_s"), islands.nearest_other(p), islands.pair_overlap(p),
        islands.range_candidates(spark.createDataFrame([(1, 0.0, 1.0)], "tracklet_id int, t0 double, t1 double"), 6.0),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_filters_and_columns_reach_the_scan(spark):
    plan = spark.read.parquet(f"{DATA}/events.parquet")
    df = fixtures.table(spark, DATA, "positions").where("frame < 30").select("frame", "x_m")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id" in text and all(c not in text.split("ReadSchema")[1] for c in plan.columns if c not in ("event_id", "value"))
