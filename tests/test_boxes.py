"""The box tracker: its filter against plain matrices, its stages, its look, many matches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import boxes, tracking

COLUMNS = "frame int, t double, det_idx int, mx double, my double, x1 double, y1 double, x2 double, y2 double, conf double, look array<double>"


def plain(z, times, step):
    """A filter with eight numbers and full matrices: the means and covariances after each measurement."""
    noise = lambda h, place, ratio: np.diag([(place * h) ** 2, (place * h) ** 2, ratio**2, (place * h) ** 2])
    both = lambda a, b: np.block([[a, np.zeros((4, 4))], [np.zeros((4, 4)), b]])
    x, cov, before, out = None, None, None, []
    for t, seen in zip(times, z, strict=True):
        if x is None:
            x = np.concatenate([seen, np.zeros(4)])
            cov = both(noise(seen[3], 2 / 20, 1e-2), noise(seen[3], 10 / 160, 1e-5))
        else:
            dt = (t - before) / step
            f = np.block([[np.eye(4), dt * np.eye(4)], [np.zeros((4, 4)), np.eye(4)]])
            q = dt * both(noise(x[3], 1 / 20, 1e-2), noise(x[3], 1 / 160, 1e-5))
            x, cov = f @ x, f @ cov @ f.T + q
            h = np.hstack([np.eye(4), np.zeros((4, 4))])
            gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + noise(x[3], 1 / 20, 1e-1))
            x, cov = x + gain @ (seen - h @ x), (np.eye(8) - gain @ h) @ cov
        before = t
        out.append((x, cov))
    return out


def test_filter_is_the_plain_one():
    rng = np.random.default_rng(3)
    times = np.cumsum(rng.choice([0.12, 0.24], 30))
    z = np.column_stack([50 + 4 * times, 80 - 2 * times, np.full(30, 0.4), 30 + times]) + rng.normal(0, 0.5, (30, 4)) * [1, 1, 0.01, 1]
    m = boxes.Motion.start(z[:1])
    want = plain(z, times, 0.12)
    for i in range(1, 30):
        m.predict((times[i] - times[i - 1]) / 0.12, np.zeros(1, bool))
        m.update(np.array([0]), z[i : i + 1])
        x, cov = want[i]
        assert m.mean[0] == pytest.approx(x[:4]) and m.velocity[0] == pytest.approx(x[4:])
        assert m.pp[0] == pytest.approx(np.diag(cov)[:4]) and m.vv[0] == pytest.approx(np.diag(cov)[4:]) and m.pv[0] == pytest.approx(np.diag(cov[:4, 4:]))
    y = z[5] - m.mean[0]
    s = np.diag(want[-1][1])[:4] + np.diag(np.diag([(m.mean[0, 3] / 20) ** 2, (m.mean[0, 3] / 20) ** 2, 0.01, (m.mean[0, 3] / 20) ** 2]))
    assert m.surprise(z[5:6])[0, 0] == pytest.approx((y**2 / s).sum())


def rows_of(spark, rows, wide=20):
    """rows: (frame, det_idx, x of the box, confidence, look)."""
    return spark.createDataFrame([(f, f / 25, i, float(x), 5.0, float(x), 100.0, float(x) + wide, 150.0, c, v) for f, i, x, c, v in rows], COLUMNS)


def found(df):
    return {(r["frame"], r["det_idx"]): r["tracklet_id"] for r in df.collect()}


def test_stages(spark):
    """Unsure boxes continue a track but open none; a track outlives a gap within its buffer, and its velocity carries it over."""
    rows = [(3 * i, 0, 6 * i, 0.3 if 4 <= i < 6 else 0.9, None) for i in range(14) if i not in (8, 9, 10)] + [(3 * i, 1, 400, 0.3, None) for i in range(14)]
    got = found(tracking.box_tracker(rows_of(spark, rows)))
    assert {k[1] for k in got} == {0} and set(got.values()) == {1} and len(got) == 11
    short = found(tracking.box_tracker(rows_of(spark, rows), boxes.Boxes(buffer_s=0.2)))
    assert len(set(short.values())) == 2


def test_gate_of_innovations(spark):
    """A box that stood still and is 15 px off fits by overlap, not by its filter; a new track's wide filter takes such a step."""
    gate, still = boxes.Boxes(gate=9.4877), [(3 * i, 0, 0, 0.9, None) for i in range(15)]
    jump = rows_of(spark, [*still, (45, 0, 15, 0.9, None)])
    assert len(set(found(tracking.box_tracker(jump)).values())) == 1 and len(set(found(tracking.box_tracker(jump, gate)).values())) == 2
    assert len(set(found(tracking.box_tracker(rows_of(spark, [still[0], (3, 0, 15, 0.9, None)]), gate)).values())) == 1


def test_confirmation(spark):
    rows = [(3 * i, 0, i, 0.9, None) for i in range(5)] + [(6, 1, 300, 0.9, None)]
    got = found(tracking.box_tracker(rows_of(spark, rows), boxes.Boxes(confirm=2)))
    assert {k[1] for k in got} == {0} and (0, 0) not in got and len(got) == 4


def crossing(red, blue):
    """Two boxes come together, stand on each other, and part the way they came: overlap alone lets them pass through each other."""
    out = []
    for i in range(17):
        gap = 7 * abs(8 - i)
        left, right = (0, red, 100 - gap), (1, blue, 100 + gap)
        out += [(3 * i, k, x, 0.9, v) for k, v, x in (left, right)]
    return out


def test_look_avoids_a_swap(spark):
    df = rows_of(spark, crossing([1.0, 0.0], [0.0, 1.0]), 60)
    kept = lambda got: (got[0, 0] == got[48, 0], got[0, 1] == got[48, 1])
    assert kept(found(tracking.box_tracker(df))) == (False, False)
    assert found(tracking.box_tracker(df, vector="look")) == found(tracking.box_tracker(df))  # off by default
    look = boxes.Look(separation=2**0.5, weight=2.0)
    assert kept(found(tracking.box_tracker(df, vector="look", look=look))) == (True, True)
    blind = df.withColumn("look", F.lit(None).cast("array<double>"))
    assert found(tracking.box_tracker(blind, vector="look", look=look)) == found(tracking.box_tracker(blind))
    same = rows_of(spark, crossing([1.0, 0.0], [1.0, 0.0]), 60)
    assert kept(found(tracking.box_tracker(same, vector="look", look=look))) == (False, False)


def test_gate_of_the_look(spark):
    rows = [(3 * i, 0, 2 * i, 0.9, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)]
    look = boxes.Look(separation=1.0, weight=0.0, most=0.9)
    no_twins = boxes.Boxes(twin=0.0)  # else the older track of the same box ends the new one
    assert len(set(found(tracking.box_tracker(rows_of(spark, rows), no_twins, "look", look)).values())) == 2
    with pytest.raises(ValueError):
        tracking.box_tracker(rows_of(spark, rows), look=look)


def test_two_matches_are_two_runs(spark):
    one = rows_of(spark, crossing([1.0, 0.0], [0.0, 1.0]), 60)
    two = one.withColumn("match_no", F.lit(1)).unionByName(one.withColumns({"match_no": F.lit(2), "x1": F.col("x1") + 500, "x2": F.col("x2") + 500}))
    alone = found(tracking.box_tracker(one))
    got = tracking.box_tracker(two, key="match_no").collect()
    for m in (1, 2):
        assert {(r["frame"], r["det_idx"]): r["tracklet_id"] for r in got if r["match_no"] == m} == alone
