"""Vetoes and cost terms of stitching by colour, label and velocity."""

import pytest

from pitchlake.operators import tracking


def test_vetoes_and_costs(spark):
    schema = "tracklet_id int, t0 double, t1 double, x0 double, y0 double, x1 double, y1 double, vx double, vy double, col array<double>, lab string"
    b = lambda i, col, lab: (i, 2.0, 3.0, 7.0, 5.0, 9.0, 5.0, 0.0, 0.0, col, lab)
    t = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 5.0, 5.0, 5.0, 1.0, 0.0, [0.0, 0.0], "A"), b(2, [0.6, 0.0], "A"), b(3, [3.0, 0.0], "A"), b(4, [0.0, 0.0], "B"), b(5, None, None)], schema)
    cost = lambda **more: {r["b"]: r["cost"] for r in tracking.stitch_candidates(t, **more).collect()}
    base = 1 / 4.2 + 0.3 / 6
    assert cost() == {i: pytest.approx(base) for i in (2, 3, 4, 5)}
    assert cost(label="lab") == {i: pytest.approx(base) for i in (2, 3, 5)}
    assert cost(colour="col") == {2: pytest.approx(base + 0.15 * 0.5), 4: pytest.approx(base), 5: pytest.approx(base)}
    assert cost(speed_weight=0.5, v_ref=4.0)[2] == pytest.approx(base + 0.5 * 1 / 4)
