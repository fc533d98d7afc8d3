"""Scores of long matches: ranges and pieces of a match give what one reading gives."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import evaluation


def _walks(spark, frames, people, first, shift, change=None):
    """People on lines of their own; every ``change`` frames the first two exchange their names."""
    i, frame = F.col("id") % people, F.floor(F.col("id") / people)
    name = F.when((i < 2) & (F.floor(frame / change) % 2 == 1), 1 - i).otherwise(i) if change else i
    rows = spark.range(frames * people).where(frame % 7 != i)
    return rows.select(frame.cast("int").alias("frame"), (first + name).cast("int").alias("obj_id"), (i * 1.5 + shift + F.sin(frame / 40 + i) * 0.4).alias("x_m"), (10.0 + (frame * (i + 3)) % 11 * 0.05 * shift).alias("y_m"))


def _plain(g, p, t, box=2.0):
    """HOTA of one threshold for pairs that nobody contests, row by row."""
    at = lambda rows: {(r["frame"], r["obj_id"]): (r["x_m"], r["y_m"]) for r in rows}
    g, p = at(g), at(p)
    n_g, n_p, n = {}, {}, {}
    for names, rows in ((n_g, g), (n_p, p)):
        for _, i in rows:
            names[i] = names.get(i, 0) + 1
    for (f, i), (x, y) in g.items():
        for j, (u, v) in [(k, p[f, k]) for k in n_p if (f, k) in p]:
            w, h = max(box - abs(x - u), 0), max(box - abs(y - v), 0)
            if w * h / (2 * box**2 - w * h) >= t:
                n[i, j] = n.get((i, j), 0) + 1
    tp = sum(n.values())
    det = tp / (len(g) + len(p) - tp)
    return math.sqrt(det * sum(c * c / (n_g[i] + n_p[j] - c) for (i, j), c in n.items()) / tp), det


def test_hota_over_many_ranges_equals_plain_python(spark):
    g, p = _walks(spark, 4_000, 3, 100, 0.0), _walks(spark, 4_000, 3, 1, 0.2, 1_700)
    # far enough apart that boxes of two people never overlap by half
    got = {r["threshold"]: r for r in evaluation.hota(g, p).collect()}
    want = _plain(g.collect(), p.collect(), 0.5)
    assert len(got) == 19 and (got[0.5]["hota"], got[0.5]["det_a"]) == pytest.approx(want) and 0.3 < want[0] < 0.99


def test_hota_of_a_long_match(spark):
    """12,000 frames of 12 people whose boxes overlap their neighbours': one task that matched each frame once for each threshold took minutes."""
    g, p = _walks(spark, 12_000, 12, 100, 0.0), _walks(spark, 12_000, 12, 1, 0.3, 500)
    began = time.monotonic()
    rows = evaluation.hota(g, p).collect()
    assert len(rows) == 19 and all(0 <= r["hota"] <= 1 for r in rows)
    assert time.monotonic() - began < 60


def test_hota_without_pairs_or_rows(spark):
    one = _walks(spark, 30, 2, 1, 0.0)
    assert [(r["hota"], r["det_a"]) for r in evaluation.hota(one, one.where("false"), (0.5,)).collect()] == [(0.0, 0.0)]
    assert evaluation.hota(one.where("false"), one.where("false")).collect() == []
    keyed = lambda df: df.withColumn("m", F.lit(1)).unionByName(df.withColumn("m", F.lit(None).cast("int")))
    assert {(r["m"], r["hota"]) for r in evaluation.hota(keyed(one), keyed(one), (0.5,), key="m").collect()} == {(1, 1.0), (None, 1.0)}


@pytest.mark.parametrize("warm", [0, 20])
def test_clear_mot_in_pieces_is_that_of_one_reading(spark, warm):
    """Pairs that go on, and names that change, over the ends of pieces."""
    g, p = _walks(spark, 600, 5, 100, 0.0), _walks(spark, 600, 5, 1, 0.3, 50)
    whole = evaluation.clear_mot(g, p).first()
    assert whole["switches"] > 10
    for piece in (25, 40):
        part = evaluation.clear_mot(g, p, piece=piece, warm=warm).first()
        assert [part[c] for c in ("tp", "fn", "fp", "switches")] == [whole[c] for c in ("tp", "fn", "fp", "switches")]
        assert np.allclose([part["mota"], part["motp"]], [whole["mota"], whole["motp"]], atol=1e-12)
