"""Best paths in segments give what one reading of the match gives."""

import random

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import ball, paths, teams


def candidates(seed, frames=160, gaps=True):
    """A ball that moves, lookalikes around it, frames without any and a long stretch without candidates."""
    rng = random.Random(seed)
    rows, x, y = [], 500.0, 300.0
    for f in range(frames):
        x, y = x + rng.uniform(-30, 35), y + rng.uniform(-20, 20)
        if gaps and (60 <= f < 90 or rng.random() < 0.2):
            continue
        at = [(x, y)] if rng.random() < 0.8 else []
        at += [(rng.uniform(0, 1900), rng.uniform(0, 1000)) for _ in range(rng.randrange(3))]
        rng.shuffle(at)
        rows += [(f, f / 8.0, i, px, py, rng.choice([-1.0, 0.5, 1.25])) for i, (px, py) in enumerate(at)]
    return rows


@pytest.fixture(scope="module")
def matches(spark):
    rows = [(m, *r) for m in range(3) for r in candidates(m, 160 + 90 * m, m != 2)]
    return spark.createDataFrame(rows, "match_no int, frame int, t double, cand_idx int, px double, py double, log_lr double").cache()


def picked(df, *by):
    return sorted(tuple(r[c] for c in by) for r in df.collect())


@pytest.mark.parametrize("seconds", [1.0, 3.0, 1000.0])
def test_ball_in_segments(matches, seconds):
    one = picked(ball.best_path(matches, key="match_no"), "match_no", "frame", "cand_idx")
    assert len(one) > 100
    assert picked(ball.best_path(matches, key="match_no", seconds=seconds), "match_no", "frame", "cand_idx") == one


def test_referee_in_segments(matches):
    cands = matches.withColumns({"det_idx": F.col("cand_idx"), "mx": F.col("px") / 20, "my": F.col("py") / 20})
    one = picked(teams.referee_path(cands, key="match_no"), "match_no", "frame", "det_idx")
    assert one
    assert picked(teams.referee_path(cands, key="match_no", seconds=5.0), "match_no", "frame", "det_idx") == one


def test_deep_tree(matches):
    """Two members a node: many levels, still the same path; and no key at all."""
    cands = matches.where("match_no = 1").drop("match_no")
    chain = paths.Chain(0.5, lambda dt, off, between: (abs(off).sum(1) > 100 * dt + 20) * 1e9 + between, 3.0, (1.0, 1.0), ("px", "py"), tie=lambda rank: float(rank > 0))
    once = picked(paths.cheapest(cands, chain, "cand_idx", 10_000.0), "frame", "cand_idx")
    assert once and picked(paths.cheapest(cands, chain, "cand_idx", 1.0, fan=2), "frame", "cand_idx") == once


def test_against_all_paths(spark):
    """The least cost over all choices of a small match, by trying them all."""
    import itertools

    rows = [r for r in candidates(11, 7, False) if r[2] < 2]
    frames = sorted({r[0] for r in rows})
    by = {f: [r for r in rows if r[0] == f] for f in frames}

    def cost(choice):
        total, last, hidden = 0.0, None, None
        for k, r in enumerate(choice):
            if r is None:
                total += 1.0
                continue
            near = last is not None and r[1] - choice[last][1] <= 0.5 and ((r[3] - choice[last][3]) ** 2 + (r[4] - choice[last][4]) ** 2) ** 0.5 <= 1000 * (r[1] - choice[last][1]) + 20
            if not near:
                if last == k - 1 and last is not None:
                    return float("inf")
                total += 3.0
            last = k
        return total

    least = min(cost(c) for c in itertools.product(*([None, *by[f]] for f in frames)))
    df = spark.createDataFrame(rows, "frame int, t double, cand_idx int, px double, py double, log_lr double")
    got = {r["frame"]: tuple(r) for r in ball.best_path(df, seconds=1.0).select(*df.columns).collect()}
    assert cost([got.get(f) for f in frames]) == least


def test_empty_and_bad_length(spark, matches):
    assert ball.best_path(matches.where("false"), key="match_no", seconds=5.0).collect() == []
    with pytest.raises(ValueError, match="twice"):
        ball.best_path(matches, seconds=0.5)


def test_same_frame_numbers_do_not_mix(matches):
    """Two matches with the same frames: each gives what it gives alone."""
    both = picked(ball.best_path(matches, key="match_no", seconds=3.0), "match_no", "frame", "cand_idx")
    alone = [(m, *r) for m in range(3) for r in picked(ball.best_path(matches.where(f"match_no = {m}"), seconds=3.0), "frame", "cand_idx")]
    assert both == sorted(alone)
