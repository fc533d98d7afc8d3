"""Trackers over overlapping stretches give the identities of one run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import stretches, tracking


@pytest.fixture(scope="module")
def dets(spark):
    """Ten people that walk in lanes, two matches; one leaves for a while, detections go missing."""
    rng, rows = np.random.default_rng(4), []
    for m in range(2):
        for f in range(900):
            seen = [p for p in range(10) if rng.random() < 0.97 and not (p == 3 and 300 < f < 420)]
            rng.shuffle(seen)
            rows += [(m, f, f * 0.12, i, float(p * 9 + 2 * np.sin(f / 40 + p)), float(20 + 15 * np.cos(f / 60 + p + m)), int(p)) for i, p in enumerate(seen)]
    return spark.createDataFrame(rows, "match_no int, frame int, t double, det_idx int, mx double, my double, person int").cache()


def sets(rows, by):
    out = {}
    for r in rows:
        out.setdefault((r["match_no"], r[by]), set()).add((r["frame"], r["det_idx"]))
    return sorted((k[0], sorted(v)) for k, v in out.items())


@pytest.mark.parametrize(("seconds", "overlap"), [(36.0, 8.0), (20.0, 10.0), (1000.0, 10.0)])
def test_equal_to_one_run(dets, seconds, overlap):
    one = tracking.conservative_tracker(dets, 0.12, key="match_no").collect()
    got, left = stretches.tracked_in_stretches(dets, lambda d, by: tracking.conservative_tracker(d, 0.12, key=by), seconds, overlap, "match_no")
    assert sets(got.collect(), "identity_id") == sets(one, "tracklet_id")
    assert left.count() == 0


def test_each_row_once_and_no_key(dets):
    match = dets.where("match_no = 1").drop("match_no")
    got, _ = stretches.tracked_in_stretches(match, lambda d, by: tracking.conservative_tracker(d, 0.12, key=by), 30.0, 6.0)
    one = tracking.conservative_tracker(match, 0.12)
    assert got.count() == got.select("frame", "det_idx").distinct().count() == one.count()


def test_agreement_is_mutual_and_counts(spark):
    rows = [(0, 0, 1, f, 0) for f in range(10)] + [(0, 1, 5, f, 0) for f in range(7)] + [(0, 1, 6, f, 0) for f in range(7, 10)]
    got = stretches.agreement(spark.createDataFrame(rows, "match int, stretch int, tracklet_id int, frame int, det_idx int")).collect()
    assert {(r["a"], r["b"], r["shared"], r["mutual"]) for r in got} == {(1, 5, 7, True), (1, 6, 3, False)}


def test_spread(spark):
    rows = spark.createDataFrame([(0.0,), (8.9,), (9.0,), (9.9,), (10.0,), (18.5,)], "t double")
    got = sorted((r["t"], r["stretch"]) for r in stretches.spread(rows, 10.0, 1.0).collect())
    assert got == [(0.0, 0), (8.9, 0), (9.0, 0), (9.0, 1), (9.9, 0), (9.9, 1), (10.0, 1), (18.5, 1), (18.5, 2)]
    with pytest.raises(ValueError, match="half"):
        stretches.spread(rows, 10.0, 6.0)


def test_empty(dets):
    got, left = stretches.tracked_in_stretches(dets.where("false"), lambda d, by: tracking.conservative_tracker(d, 0.12, key=by), key="match_no")
    assert got.count() == 0 and left.count() == 0
