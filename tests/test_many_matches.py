"""Queries over many matches give what each match alone gives."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import ball, evaluation, teams, tracking
from pitchlake.plans import fixtures, matches, profiles, q_matches
from pitchlake.plans.q_matches import KEY, LENGTH, of_match
from pitchlake.plans.q_tracking import _pred, _tracklets

#: The smallest tables hold a single match; these hold three.
DATA = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(q_matches.ORACLES))
def test_sql(spark, duck, name):
    df = q_matches.QUERIES[name](spark, DATA)
    out = duck.sql(q_matches.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(out.columns)
    theirs = sorted((tuple(r[out.columns.index(c)] for c in cols) for r in out.fetchall()), key=repr)
    assert len({r[cols.index("match_no")] for r in theirs}) > 1
    assert rows(df, cols) == theirs


def _evaluated(g, p):
    return g, _pred(p).join(g.select("frame").distinct(), "frame", "left_semi")


ALONE = {
    "conservative_tracker": lambda t: tracking.conservative_tracker(t("detections"), 0.12),
    "stitch_greedy": lambda t: tracking.choose_links(tracking.stitch_candidates(tracking.summaries(_tracklets(t("positions"))))).withColumn("cost", F.expr("floor(cost * 1e6 + 0.5) / 1e6")),
    "purity_stitch": lambda t: _tracklets(t("positions")).select("tracklet_id").join(tracking.purity_stitch(_tracklets(t("positions"))), "tracklet_id").groupBy("identity_id").agg(F.count("*").alias("n")),
    "profile_candidato": lambda t: profiles.run(t("detections")),
    "profile_oficial": lambda t: profiles.run(t("detections"), profiles.Profile("oficial")),
    "profile_bytetrack": lambda t: profiles.run(t("detections"), profiles.Profile("bytetrack")),
    "hota": lambda t: evaluation.hota(*_evaluated(t("gt_obs"), t("positions"))),
    "clear_mot": lambda t: evaluation.clear_mot(*_evaluated(t("gt_obs"), t("positions"))),
    "ball_viterbi": lambda t: ball.best_path(t("ball_cand")).select("frame", "cand_idx"),
    "referee_path": lambda t: teams.referee_path(t("detections").select("frame", "t", "det_idx", "mx", "my", F.when(F.col("det_idx") == 11, 1.0).otherwise(-1.0).alias("log_lr"))),
}


@pytest.mark.parametrize("name", sorted(ALONE))
def test_each_match_alone(spark, name):
    both = q_matches.QUERIES[f"{name}_by_match"](spark, DATA).cache()
    cols = sorted(c for c in both.columns if c not in KEY)
    found = {r["match_no"] for r in both.select(*KEY).distinct().collect()}
    assert len(found) > 1
    for m in (1,) if name.startswith("profile") else (0, 1):
        alone = ALONE[name](lambda n, m=m: fixtures.table(spark, DATA, n).where(F.floor(F.col("frame") / LENGTH) == m))
        want = rows(alone, cols)
        assert want and rows(both.where(F.col("match_no") == m), cols) == want
    both.unpersist()


def test_profile_of_matches_whose_frames_and_times_are_the_same(spark):
    """Two matches with equal clocks: every step has to keep them apart by their number."""
    d = fixtures.table(spark, DATA, "detections").where(F.col("frame") < LENGTH)
    one = d.withColumn("match_no", F.lit(3))
    other = d.withColumns({"match_no": F.lit(8), "mx": F.col("mx") + F.col("det_idx") % 3 * 0.05})
    got = profiles.run_matches(one.unionByName(other))
    cols = sorted(c for c in got.columns if c not in KEY)
    got.cache()
    for m, part in ((3, one), (8, other)):
        want = rows(profiles.run(part.drop("match_no")), cols)
        assert want and rows(got.where(F.col("match_no") == m), cols) == want


def test_stitch_global_and_trackers_by_match(spark):
    links = q_matches.QUERIES["stitch_global_by_match"](spark, DATA).collect()
    # a tracklet has one successor and one predecessor in its match, and links stay in theirs
    for end in ("a", "b"):
        seen = [(r["match_no"], r[end]) for r in links]
        assert len(seen) == len(set(seen))
    for name in ("appearance_tracker", "relink_at_crossings"):
        out = q_matches.QUERIES[f"{name}_by_match"](spark, DATA)
        assert len({r["match_no"] for r in out.collect()}) > 1
    got = of_match(q_matches.QUERIES["appearance_tracker_by_match"](spark, DATA).drop("match_no")).groupBy(*KEY).agg(F.min("tracklet_id").alias("first"))
    # numbers begin anew in each match
    assert all(r["first"] < matches.ROOM for r in got.collect())
