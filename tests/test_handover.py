"""A state handed from piece to piece gives what one reading gives, and a task holds a piece."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import handover, review, teams, tracking
from pitchlake.plans import fixtures


@pytest.mark.parametrize("forgets", [True, False])
def test_states_are_those_of_one_reading(spark, forgets):
    """The last value, and the sum of all values, which no piece can guess."""
    rows = spark.range(200).select(F.col("id").cast("int").alias("frame"), (F.col("id") / 10.0).alias("t"), ((F.col("id") * 7) % 11).cast("double").alias("v"))

    def read(state, g):
        v = g["v"].tolist()
        before = 0.0 if state is None else state[0]
        return np.array([(v[-1] if v else before) if forgets else before + sum(v)])

    got = {r["_n"]: r["start"][0] for r in handover.settled(handover.pieces(rows, 3.0, 1.0), read, ["frame"]).collect()}
    v = [(i * 7) % 11 for i in range(200)]
    assert got == {n: float((v[30 * n - 1] if n else 0) if forgets else sum(v[: 30 * n])) for n in range(7)}


def test_referee_among_many(spark):
    """4,000 frames of 24: each candidate against each of the last 20 frames took most of a minute in one task."""
    cands = spark.range(4000 * 24).select((F.col("id") / 24).cast("int").alias("frame"), (F.col("id") % 24).cast("int").alias("det_idx"))
    cands = cands.select("frame", "det_idx", (F.col("frame") * 0.12).alias("t"), (F.col("det_idx") * 3.0 + F.col("frame") % 5 * 0.1).alias("mx"), (F.col("det_idx") * 2.0).alias("my"), F.when(F.col("det_idx") == 11, 1.0).otherwise(-1.0).alias("log_lr"))
    began = time.monotonic()
    got = teams.referee_path(cands, seconds=60.0).collect()
    assert time.monotonic() - began < 25
    assert sorted((r["frame"], r["det_idx"]) for r in got) == [(f, 11) for f in range(4000)]


@pytest.mark.parametrize("name", ["conservative", "box"])
def test_tracks_in_pieces_are_those_of_one_reading(spark, name):
    """Tracks that go on over the ends of pieces keep their numbers."""
    dets = fixtures.table(spark, "/root/testdata/sf0.01", "detections").where("frame < 600").cache()
    run = lambda s: tracking.conservative_tracker(dets, 0.12, seconds=s) if name == "conservative" else tracking.box_tracker(dets, seconds=s)
    rows = lambda df: sorted((r["tracklet_id"], r["frame"], r["det_idx"]) for r in df.collect())
    assert rows(run(6.0)) == rows(run(None)) != []


def _looks(spark, n, look):
    """Frames of two people 1.5 m apart who change sides now and then; ``look(frame, person)``: a vector or nothing."""
    rows = [(f, f * 0.1, d, 20.0 + 1.5 * (d ^ (f // 7) % 2), 30.0, 0.9, look(f, d)) for f in range(n) for d in range(2)]
    return spark.createDataFrame(rows, "frame int, t double, det_idx int, mx double, my double, conf double, emb array<float>").cache()


def _tracks(df):
    return sorted((r["tracklet_id"], r["frame"], r["det_idx"]) for r in df.collect())


@pytest.mark.parametrize("every", [1, 40, 161])
def test_looks_that_tracks_carry_over_pieces(spark, every):
    """A look from pieces ago decides who is who; a guess of 2 s does not know it."""
    dets = _looks(spark, 600, lambda f, d: [1.0, 0.0] if f % every == 0 and d else [0.0, 1.0] if f % every == 0 else None)
    want = _tracks(tracking.appearance_tracker(dets))
    assert len(want) == 1200 and {t for t, _, _ in want} == {1, 2}
    # without its looks before frame 300 the match has other tracks: they decide
    blank = dets.withColumn("emb", F.when(F.col("frame") >= 300, F.col("emb")))
    assert every == 1 or _tracks(tracking.appearance_tracker(blank)) != want
    assert _tracks(tracking.appearance_tracker(dets, seconds=4.0)) == want


def test_looks_that_nobody_asks_for(spark):
    """Looks of the first frame only, carried over 100 pieces: to read a piece after another again took a round of jobs for each, minutes in all."""
    dets = _looks(spark, 4000, lambda f, d: [float(d), 1.0] if f == 0 else None)
    began = time.monotonic()
    got = _tracks(tracking.appearance_tracker(dets, seconds=4.0))
    assert time.monotonic() - began < 60
    assert got == _tracks(tracking.appearance_tracker(dets))


def test_frames_of_one_person_in_pieces(spark):
    """Tracks that end, a piece without rows, two matches, one of them without a number."""
    rows = [(m, f, f * 0.1, 0, 10.0 + f % 2, 20.0, 0.9, [1.0] if f % 50 == 0 else None) for m in (7, None) for f in range(300) if not 75 <= f < 165 and (m or f < 250)]
    dets = spark.createDataFrame(rows, "match int, frame int, t double, det_idx int, mx double, my double, conf double, emb array<float>").cache()
    rows = lambda df: sorted((r["match"] or 0, r["tracklet_id"], r["frame"]) for r in df.collect())
    want = rows(tracking.appearance_tracker(dets, key="match"))
    assert [m for m, _, _ in want].count(7) == 210 and {n for _, n, _ in want} == {1, 2}
    assert rows(tracking.appearance_tracker(dets, key="match", seconds=4.0)) == want


def test_field_prior_in_pieces(spark):
    """What is in reach depends on the last frame, also over the ends of pieces."""
    cands = spark.range(900).select((F.col("id") / 3).cast("int").alias("frame"), (F.col("id") % 3).cast("int").alias("cand_idx"), (F.floor(F.col("id") / 3) * 0.1).alias("t"), ((F.col("id") * 37) % 101).cast("double").alias("mx"), ((F.col("id") * 17) % 61).cast("double").alias("my"))
    rows = lambda s: sorted((r["frame"], r["cand_idx"]) for r in review.field_prior(cands, 100.0, 64.0, seconds=s).collect())
    assert 0 < len(rows(None)) < 900
    assert rows(5.0) == rows(None)


def test_a_second_choice_about_as_good_ends_a_tracklet():
    """One frame of the conservative tracker against the rule, pair by pair."""
    from pitchlake.operators import matching

    rng, p, dt = np.random.default_rng(5), tracking.Conservative(), 0.12
    radius = p.v_max * dt + p.margin
    for n, m in ((0, 3), (1, 1), (1, 4), (4, 1), (6, 5), (5, 6), (9, 9)) * 20:
        places, pos = rng.random((n, 2)) * 4, rng.random((m, 2)) * 4
        tracks = [tracking.Track(i + 1, 0.0, x) for i, x in enumerate(places)]
        d = np.linalg.norm(places[:, None] - pos[None], axis=2)
        want = [-1] * m
        for r, c in zip(*matching.assign(d), strict=True):
            rivals = [sorted(line)[1] for line in (d[r], d[:, c]) if len(line) > 1]
            if d[r, c] <= radius and all(x >= d[r, c] + p.ambiguity * radius for x in rivals):
                want[c] = int(r) + 1
        for c in range(m):
            if want[c] < 0:
                n += 1
                want[c] = n
        assert tracking.advance(tracks, len(places) + 1, dt, pos, p, dt)[2] == want
