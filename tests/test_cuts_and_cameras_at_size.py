"""Cuts of long tracklets in pieces of time, fits of many trials in one group."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import pitch, tracking

from .test_calibration import clicks
from .test_keys_and_parts import brute_cuts

ROWS = "tracklet_id int, frame int, t double, x_m double, y_m double, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("piece", [1.0, 7.0, 60.0])
def test_cuts_near_the_ends_of_pieces(spark, piece):
    rng = np.random.default_rng(11)
    rows, at = [], np.array([40.0, 30.0])
    for k in range(500):
        if rng.random() < 0.08:
            at = np.clip(at + rng.choice([-6.0, 6.0], 2), 5, 60)
        x1, y1 = 10 * at
        tall = rng.choice([1.0, 1.6], p=[0.8, 0.2])
        rows.append((3 * k / 25, *(at + rng.normal(0, 0.2, 2)), x1, y1 - 40 * tall + rng.normal(), x1 + 15, y1))
    df = spark.createDataFrame([(7, 3 * k, *map(float, r)) for k, r in enumerate(rows)], ROWS)
    # rows without a time or a tracklet change nothing
    df = df.unionByName(spark.createDataFrame([(7, 1, None, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0), (None, 1, 0.5, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0)], ROWS))
    got = sorted(r["frame"] // 3 for r in tracking.fused_cuts(df, piece_s=piece).collect())
    assert len(got) > 5 and got == brute_cuts(rows)


def test_cuts_of_long_tracklets(spark):
    """8 tracklets of 12,000 rows that jump every 20: medians of every row's windows took more than a minute."""
    k, own = F.floor(F.col("id") / 8), F.floor(F.col("id") / 160) % 2
    df = spark.range(96_000).select((F.col("id") % 8).cast("int").alias("tracklet_id"), (3 * k).cast("int").alias("frame"), (k * 0.12).alias("t"), (10.0 + own * 5).alias("x_m"), F.lit(20.0).alias("y_m"), (own * 50.0).alias("x1"), (300 + own * 50.0 - F.when(k % 20 < 2, 40).otherwise(0)).alias("y1"), (own * 50.0 + 15).alias("x2"), (340 + own * 50.0).alias("y2"))
    began = time.monotonic()
    got = tracking.fused_cuts(df).groupBy("tracklet_id").agg(F.count("*").alias("n"), F.sum(F.col("frame") % 60).alias("off")).collect()
    assert [(r["n"], r["off"]) for r in got] == [(599, 0)] * 8
    assert time.monotonic() - began < 30


def test_fits_of_one_group_are_those_of_their_own_groups(spark):
    rows = clicks(spark).withColumn("trial", F.explode(F.array(*map(F.lit, range(4))))).withColumn("px", F.col("px") + F.col("trial") * (F.xxhash64("name") % 5))
    rows = rows.where("trial < 3 or name < 'p3'")
    of = lambda df: sorted((r["camera"], r["trial"], r["h"], r["inliers"], r["clicks"], r["error_m"]) for r in df.collect())
    got = of(pitch.fit_homography(rows, 5.0, ["camera"], 20, "trial"))
    # the trial of three clicks has no fit
    assert len(got) == 6 and got == of(pitch.fit_homography(rows, 5.0, ["camera", "trial"], 20))


def test_stability_of_many_cameras(spark):
    """Six cameras of 300 trials were 1,800 groups of 60 fits one by one, which took more than a minute."""
    began = time.monotonic()
    got = pitch.click_stability(clicks(spark, "abcdef"), [(50.0, 30.0)], 1.0, key=["camera"]).collect()
    assert len(got) == 6 and all(r["fits"] == 300 for r in got)
    assert time.monotonic() - began < 30
