"""Matching of observations: four kinds that give different results, so they have different names.

``optimal_then_threshold`` matches a frame at least total distance and then drops
pairs that are too far; ``threshold_then_optimal`` never allows such pairs;
``greedy_in_order`` serves observations in their order; ``nearest`` lets several
share one detection. Frames are matched one by one, in groups of ``FRAMES``
neighbouring frame numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost assignment (shortest augmenting paths). All of the shorter side are matched."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.zeros(0, int), np.zeros(0, int)
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    least = c.argmin(1)
    if len(set(least.tolist())) == n and ((c <= c[np.arange(n), least][:, None]).sum(1) == 1).all():
        # everyone has a first choice of their own: nothing else costs as little
        return (least, np.arange(n)) if flipped else (np.arange(n), least)
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    taker, came = np.zeros(m + 1, int), np.zeros(m + 1, int)  # row of a column (0: none), column before it on the path
    for row in range(1, n + 1):
        taker[0], at = row, 0
        slack, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while taker[at]:
            done[at] = True
            spare = c[taker[at] - 1] - row_price[taker[at]] - col_price[1:]
            less = ~done[1:] & (spare < slack[1:])
            slack[1:][less], came[1:][less] = spare[less], at
            nxt = int(np.where(done, np.inf, slack)[1:].argmin()) + 1
            step = slack[nxt]
            row_price[taker[done]] += step
            col_price[done] -= step
            slack[~done] -= step
            at = nxt
        while at:
            taker[at], at = taker[came[at]], came[at]
    cols = np.flatnonzero(taker[1:])
    rows = taker[1:][cols] - 1
    order = np.argsort(rows)
    rows, cols = rows[order], cols[order]
    return (cols, rows) if flipped else (rows, cols)


def most_gain(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs that gain most together; rows, columns and pairs that gain nothing are left out."""
    some = gain > 0
    rows, cols = np.flatnonzero(some.any(1)), np.flatnonzero(some.any(0))
    r, c = assign(-gain[np.ix_(rows, cols)])
    r, c = rows[r], cols[c]
    return r[some[r, c]], c[some[r, c]]


#: Frame numbers that one task's group spans.
FRAMES = 1500


def _threshold(y: np.ndarray, fixed: float | None) -> np.ndarray:
    return np.full(len(y), fixed) if fixed is not None else np.clip(0.4 + 0.045 * y, 1.0, 4.0)


_PAIRS = "frame int, gt_id int, pred_id int, distance double"


def _per_frame(gt: DataFrame, pred: DataFrame, pairs) -> DataFrame:
    """gt and pred: ``frame, obj_id, x_m, y_m``. pairs: row and column numbers from the truths' y and a frame's distances."""

    def columns(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        rows = rows.sort_values(["frame", "obj_id"])
        return tuple(rows[c].to_numpy() for c in ("frame", "obj_id", "x_m", "y_m"))

    def run(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        (gf, gi, gx, gy), (pf, pi, px, py) = columns(g), columns(p)
        out: list[tuple[np.ndarray, ...]] = []
        for f in np.intersect1d(gf, pf):
            a, b = slice(*np.searchsorted(gf, (f, f + 1))), slice(*np.searchsorted(pf, (f, f + 1)))
            d = np.hypot(gx[a, None] - px[None, b], gy[a, None] - py[None, b])
            r, c = pairs(gy[a], d)
            out.append((np.full(len(r), f), gi[a][r], pi[b][c], d[r, c]))
        found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        return pd.DataFrame({n: x.astype(t) for n, x, t in zip(("frame", "gt_id", "pred_id", "distance"), found, ("int32", "int32", "int32", "float64"), strict=True)})

    dealt = lambda df: df.select("frame", "obj_id", "x_m", "y_m", F.floor(F.col("frame") / FRAMES).alias("_range")).groupBy("_range")
    return dealt(gt).cogroup(dealt(pred)).applyInPandas(run, _PAIRS)


def optimal_then_threshold(gt: DataFrame, pred: DataFrame, threshold: float | None = None) -> DataFrame:
    """Least total distance, then pairs within the threshold (by default one that grows with depth)."""
    def pairs(y: np.ndarray, d: np.ndarray):
        r, c = assign(d)
        keep = d[r, c] <= _threshold(y, threshold)[r]
        return r[keep], c[keep]

    return _per_frame(gt, pred, pairs)


def threshold_then_optimal(gt: DataFrame, pred: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Pairs beyond the threshold cost so much that only others remain."""
    def pairs(y: np.ndarray, d: np.ndarray):
        r, c = assign(np.where(d > threshold, 1e6, d))
        keep = d[r, c] <= threshold
        return r[keep], c[keep]

    return _per_frame(gt, pred, pairs)


def greedy_in_order(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Each truth, by id, takes the nearest detection still free, if nearer than clip(1.5 + 0.09 y, 1.5, 6)."""
    def pairs(y: np.ndarray, d: np.ndarray):
        free, rows, cols = np.ones(d.shape[1], bool), [], []
        most = np.clip(1.5 + 0.09 * y, 1.5, 6.0)
        for i in range(len(y)):
            row = np.where(free, d[i], np.inf)
            j = int(row.argmin())
            if row[j] < most[i]:
                free[j] = False
                rows.append(i)
                cols.append(j)
        return np.array(rows, int), np.array(cols, int)

    return _per_frame(gt, pred, pairs)


def nearest(gt: DataFrame, pred: DataFrame, radius: float | Column = 2.0) -> DataFrame:
    """Each truth with its nearest detection within a radius, which others may have too; in the JVM."""
    p = pred.select(F.col("frame").alias("p_frame"), F.col("obj_id").alias("pred_id"), F.col("x_m").alias("p_x"), F.col("y_m").alias("p_y"))
    away = F.sqrt((F.col("x_m") - F.col("p_x")) ** 2 + (F.col("y_m") - F.col("p_y")) ** 2)
    met = gt.join(p, (F.col("frame") == F.col("p_frame")) & (away <= radius))
    return met.groupBy("frame", F.col("obj_id").alias("gt_id")).agg(F.min_by(F.struct("pred_id", away.alias("distance")), F.struct(away, F.col("pred_id"))).alias("b")).select("frame", "gt_id", "b.pred_id", "b.distance")


def unmatched(rows: DataFrame, other: DataFrame, radius: float = 1.0) -> DataFrame:
    """Rows without any row of the other table within a radius in their frame."""
    o = other.select(F.col("frame").alias("o_frame"), F.col("x_m").alias("o_x"), F.col("y_m").alias("o_y"))
    away = F.sqrt((F.col("x_m") - F.col("o_x")) ** 2 + (F.col("y_m") - F.col("o_y")) ** 2)
    return rows.join(o, (F.col("frame") == F.col("o_frame")) & (away <= radius), "left_anti")


def identity_map(pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One predicted id for each true id so that most frames agree, in each match (``key``).

    Counts are aggregated first; those of a match, whose ids are some hundreds, are one group.
    """
    own = key or []
    counts = pairs.groupBy(*own, "gt_id", "pred_id").agg(F.count("*").alias("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        truths, row = np.unique(g["gt_id"], return_inverse=True)
        found, column = np.unique(g["pred_id"], return_inverse=True)
        table = np.zeros((len(truths), len(found)), "i8")
        table[row, column] = g["n"]
        r, c = assign(-table)
        real = table[r, c] > 0
        return pd.DataFrame({**{k: g[k].iloc[0] for k in own}, "gt_id": truths[r[real]], "pred_id": found[c[real]], "n": table[r, c][real]})

    schema = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in (*own, "gt_id", "pred_id", "n"))
    return counts.groupBy(*own).applyInPandas(run, schema)


def same_box(a: DataFrame, b: DataFrame) -> DataFrame:
    """Numbers of detections that have the very same box in two tables."""
    keys = ["frame", "x1", "y1", "x2", "y2"]
    return a.select(*keys, F.col("det_idx").alias("a_idx")).join(b.select(*keys, F.col("det_idx").alias("b_idx")), keys).select("frame", "a_idx", "b_idx")


def box_hits(gt: DataFrame, dets: DataFrame, feet_px: float = 20.0) -> DataFrame:
    """Truths (``frame, obj_id, px, py``) that lie in a box or near its feet."""
    d = dets.select(F.col("frame").alias("d_frame"), "det_idx", "x1", "y1", "x2", "y2")
    inside = F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2"))
    feet = F.sqrt((F.col("px") - (F.col("x1") + F.col("x2")) / 2) ** 2 + (F.col("py") - F.col("y2")) ** 2) < feet_px
    return gt.join(d, (F.col("frame") == F.col("d_frame")) & (inside | feet)).groupBy("frame", "obj_id").agg(F.count("*").alias("boxes"))


def mean_alignment(gt: DataFrame, dets: DataFrame) -> DataFrame:
    """Mean distance of truths to the nearest detection of their frame."""
    d = dets.select(F.col("frame").alias("d_frame"), "mx", "my")
    away = F.sqrt((F.col("x_m") - F.col("mx")) ** 2 + (F.col("y_m") - F.col("my")) ** 2)
    each = gt.join(d, F.col("frame") == F.col("d_frame")).groupBy("frame", "obj_id").agg(F.min(away).alias("near"))
    return each.agg(F.count("*").alias("n"), fn.rounded(F.avg("near")).alias("mean_m"))
