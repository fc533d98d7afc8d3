"""Tracking boxes by overlap: recursive state estimates, two stages of association, an optional look.

A match (``key``) is one group and one sequence; scale comes from many matches. All
open tracks of a match stand in arrays, so that a frame is a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import assign

#: Fixed values of the published tracker's filter: noise of place and velocity as shares of a box's height, and for its ratio.
PLACE, VELOCITY, RATIO, RATIO_VELOCITY, RATIO_SEEN = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1


def measured(boxes: np.ndarray) -> np.ndarray:
    """Centre, ratio of width to height, and height of boxes (x1, y1, x2, y2)."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    return np.column_stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / np.maximum(h, 1e-9), h])


def corners(z: np.ndarray) -> np.ndarray:
    """The other way round."""
    w, h = z[:, 2] * z[:, 3], z[:, 3]
    return np.column_stack([z[:, 0] - w / 2, z[:, 1] - h / 2, z[:, 0] + w / 2, z[:, 1] + h / 2])


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all pairs of boxes."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.prod(np.clip(high - low, 0, None), axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return both / (area(a)[:, None] + area(b)[None] - both + 1e-9)


def _spread(height: np.ndarray, place: float, ratio: float) -> np.ndarray:
    """Variances for the four measured numbers."""
    return np.column_stack([(place * height) ** 2, (place * height) ** 2, np.full(len(height), ratio**2), (place * height) ** 2])


@dataclass
class Motion:
    """Kalman filters of many boxes.

    Noise is independent in the four measured numbers, so each has a filter of its own
    with a place and a velocity; their covariances are three arrays instead of 8 x 8 matrices.
    """

    mean: np.ndarray
    velocity: np.ndarray
    pp: np.ndarray
    pv: np.ndarray
    vv: np.ndarray

    @classmethod
    def start(cls, z: np.ndarray) -> Motion:
        return cls(z.astype(float), np.zeros(z.shape), _spread(z[:, 3], 2 * PLACE, RATIO), np.zeros(z.shape), _spread(z[:, 3], 10 * VELOCITY, RATIO_VELOCITY))

    def predict(self, steps: float, steady: np.ndarray) -> None:
        """Move on by ``steps`` of the usual length; ``steady``: boxes that do not change their height on the way."""
        self.velocity[steady, 3] = 0.0
        height = self.mean[:, 3].copy()
        self.mean = self.mean + steps * self.velocity
        self.pp = self.pp + 2 * steps * self.pv + steps**2 * self.vv + steps * _spread(height, PLACE, RATIO)
        self.pv = self.pv + steps * self.vv
        self.vv = self.vv + steps * _spread(height, VELOCITY, RATIO_VELOCITY)

    def surprise(self, z: np.ndarray) -> np.ndarray:
        """Squared innovations of all pairs, by their variances (chi-squared of four)."""
        s = self.pp + _spread(self.mean[:, 3], PLACE, RATIO_SEEN)
        return ((z[None] - self.mean[:, None]) ** 2 / s[:, None]).sum(axis=2)

    def update(self, rows: np.ndarray, z: np.ndarray) -> None:
        s = self.pp[rows] + _spread(self.mean[rows, 3], PLACE, RATIO_SEEN)
        gain_p, gain_v, off = self.pp[rows] / s, self.pv[rows] / s, z - self.mean[rows]
        self.mean[rows] += gain_p * off
        self.velocity[rows] += gain_v * off
        self.vv[rows] -= gain_v * self.pv[rows]
        self.pv[rows] *= 1 - gain_p
        self.pp[rows] *= 1 - gain_p

    def taken(self, rows: np.ndarray) -> Motion:
        return Motion(*(getattr(self, f.name)[rows] for f in fields(self)))

    def joined(self, other: Motion) -> Motion:
        return Motion(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(self)))


@dataclass(frozen=True)
class Look:
    """The look in the cost: off by default. Distances count in units of ``separation``, that of both teams' prototypes."""

    separation: float
    weight: float = 0.5
    most: float = float("inf")
    share: float = 0.2
    clean_iou: float = 0.1


@dataclass(frozen=True)
class Boxes:
    """Parameters of the tracker. ``most_cost`` is a distance, 1 less the overlap, that grows with unsure detections."""

    high: float = 0.5
    low: float = 0.1
    open_above: float = 0.1
    most_cost: float = 0.995
    most_cost_low: float = 0.5
    most_cost_new: float = 0.7
    buffer_s: float = 1.0
    step_s: float = 0.12
    confirm: int = 1
    gate: float | None = None
    twin: float = 0.15


@dataclass
class _Tracks:
    """Open tracks by row."""

    number: np.ndarray
    since: np.ndarray
    seen: np.ndarray
    streak: np.ndarray
    lost: np.ndarray
    motion: Motion
    look: np.ndarray
    known: np.ndarray

    def taken(self, rows: np.ndarray) -> _Tracks:
        return replace(self, **{f.name: getattr(self, f.name)[rows] if f.name != "motion" else self.motion.taken(rows) for f in fields(self)})

    def joined(self, other: _Tracks) -> _Tracks:
        return _Tracks(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) if f.name != "motion" else self.motion.joined(other.motion) for f in fields(self)))


@dataclass
class _Seen:
    """The detections of a frame by row."""

    boxes: np.ndarray
    z: np.ndarray
    sure: np.ndarray
    clean: np.ndarray
    looks: np.ndarray | None

    def taken(self, rows: np.ndarray) -> _Seen:
        return _Seen(self.boxes[rows], self.z[rows], self.sure[rows], self.clean[rows], None if self.looks is None else self.looks[rows])


def _met(tracks: _Tracks, seen: _Seen, most: float, weigh: bool, p: Boxes, look: Look | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tracks and of detections that belong together at least total cost."""
    if not len(tracks.number) or not len(seen.sure):
        return np.zeros(0, int), np.zeros(0, int)
    cost = 1 - overlaps(corners(tracks.motion.mean), seen.boxes)
    if look is not None:
        d = np.linalg.norm(tracks.look[:, None] - seen.looks[None], axis=2) / look.separation
        use = tracks.known[:, None] & seen.clean[None]  # the crop of an overlapped box is a mixture: it abstains
        cost = np.where(use, np.where(d > look.most, 2.0, cost + look.weight * np.nan_to_num(d)), cost)
    if weigh:
        cost = 1 - (1 - cost) * seen.sure[None]
    if p.gate is not None:
        cost = np.where(tracks.motion.surprise(seen.z) > p.gate, 2.0, cost)
    r, c = assign(np.where(cost > most, 1e6, cost))
    ok = cost[r, c] <= most
    return r[ok], c[ok]


def follow(frame: np.ndarray, t: np.ndarray, boxes: np.ndarray, conf: np.ndarray, p: Boxes, looks: np.ndarray | None = None, look: Look | None = None) -> np.ndarray:
    """The number of each row's track (0: none); rows come ordered by frame. looks: a vector for each row, NaN where there is none."""
    return _followed(_restored(None, looks.shape[1] if look is not None else 0), frame, t, boxes, conf, p, looks, look)[0]


def _restored(state: np.ndarray | None, width: int) -> tuple[_Tracks, float | None]:
    """Open tracks, numbered from 1, and the time of the last frame."""
    known = state is not None and len(state) > 0
    r = state[1:].reshape(-1, 25 + width) if known else np.zeros((0, 25 + width))
    motion = Motion(*(r[:, 4 + 4 * i : 8 + 4 * i].copy() for i in range(5)))
    tracks = _Tracks(np.arange(1, len(r) + 1), r[:, 0].copy(), r[:, 1].copy(), r[:, 2].astype("i8"), r[:, 3] > 0, motion, r[:, 25:].copy(), r[:, 24] > 0)
    return tracks, float(state[0]) if known else None


def _kept(tracks: _Tracks, before: float | None, p: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """The state after some frames and the numbers of its tracks, ordered by content."""
    if before is None:
        return np.zeros(0), np.zeros(0, "i8")
    tracks = tracks.taken(np.flatnonzero(before - tracks.seen <= p.buffer_s + 1e-9))
    m = tracks.motion
    # a streak counts up to what confirms a track
    r = np.column_stack([tracks.since, tracks.seen, np.minimum(tracks.streak, p.confirm), tracks.lost, m.mean, m.velocity, m.pp, m.pv, m.vv, tracks.known, tracks.look])
    order = np.lexsort(r.T[::-1])
    return np.r_[before, r[order].ravel()], tracks.number[order]


def _followed(start: tuple[_Tracks, float | None], frame: np.ndarray, t: np.ndarray, boxes: np.ndarray, conf: np.ndarray, p: Boxes, looks: np.ndarray | None, look: Look | None) -> tuple[np.ndarray, _Tracks, int, float | None]:
    """The numbers of the rows' tracks, the tracks left, the next number and the time of the last frame."""
    out = np.zeros(len(frame), "i8")
    tracks, before = start
    next_ = len(tracks.number) + 1
    edges = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1)) if len(frame) else np.zeros(0, int)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(frame)], strict=False):
        now, z, sure = t[a], measured(boxes[a:b]), conf[a:b]
        if before is not None and len(tracks.number):
            tracks.motion.predict((now - before) / p.step_s, tracks.lost)
        before = now
        tracks = tracks.taken(np.flatnonzero(now - tracks.seen <= p.buffer_s + 1e-9))
        touch = overlaps(boxes[a:b], boxes[a:b])
        np.fill_diagonal(touch, 0.0)
        free = touch.max(axis=1) <= look.clean_iou if look is not None and b - a > 1 else np.ones(b - a, bool)
        clean = free & ~np.isnan(looks[a:b]).any(axis=1) if look is not None else free
        matched, mine = np.zeros(len(tracks.number), bool), np.full(b - a, -1)

        here = _Seen(boxes[a:b], z, sure, clean, looks[a:b] if look is not None else None)

        def meet(rows: np.ndarray, cols: np.ndarray, most: float, weigh: bool, tracks=tracks, here=here, matched=matched, mine=mine) -> None:
            r, c = _met(tracks.taken(rows), here.taken(cols), most, weigh, p, look)
            matched[rows[r]] = True
            mine[cols[c]] = rows[r]

        firm = tracks.streak >= p.confirm
        meet(np.flatnonzero(firm), np.flatnonzero(sure >= p.high), p.most_cost, True)
        meet(np.flatnonzero(firm & ~matched & ~tracks.lost), np.flatnonzero((sure > p.low) & (sure < p.high)), p.most_cost_low, False)
        meet(np.flatnonzero(~firm), np.flatnonzero((sure >= p.high) & (mine < 0)), p.most_cost_new, True)
        cols = np.flatnonzero(mine >= 0)
        rows = mine[cols]
        tracks.motion.update(rows, z[cols])
        tracks.streak[rows] = np.where(now - tracks.seen[rows] <= 1.5 * p.step_s, tracks.streak[rows] + 1, np.maximum(tracks.streak[rows], 1))
        tracks.seen[rows], tracks.lost[:], tracks.lost[rows] = now, True, False
        if look is not None:
            own = clean[cols]
            r, c = rows[own], cols[own]
            share = look.share * (1 - touch[c].max(axis=1)) if b - a > 1 else np.full(len(r), look.share)
            share = np.where(tracks.known[r], share, 1.0)[:, None]
            tracks.look[r] = (1 - share) * np.where(tracks.known[r][:, None], tracks.look[r], 0.0) + share * looks[a + c]
            tracks.known[r] = True
        out[a + cols] = np.where(tracks.streak[rows] >= p.confirm, tracks.number[rows], 0)
        tracks = tracks.taken(np.flatnonzero(matched | firm))  # who is not confirmed yet must be seen again at once
        new = np.flatnonzero((mine < 0) & (sure >= p.high + p.open_above))
        if len(new):
            n = len(new)
            known = clean[new] if look is not None else np.zeros(n, bool)
            fresh = _Tracks(next_ + np.arange(n), np.full(n, now), np.full(n, now), np.ones(n, "i8"), np.zeros(n, bool), Motion.start(z[new]), np.where(known[:, None], looks[a + new], 0.0) if look is not None else np.zeros((n, 0)), known)
            tracks, next_ = tracks.joined(fresh), next_ + n
            out[a + new] = fresh.number if p.confirm <= 1 else 0
        open_, gone = np.flatnonzero(~tracks.lost), np.flatnonzero(tracks.lost)
        if len(open_) and len(gone):  # two tracks of one box: the older one stays
            at = corners(tracks.motion.mean)
            i, j = np.nonzero(1 - overlaps(at[open_], at[gone]) < p.twin)
            older = (tracks.seen - tracks.since)[open_[i]] > (tracks.seen - tracks.since)[gone[j]]
            drop = np.unique(np.where(older, gone[j], open_[i]))
            tracks = tracks.taken(np.setdiff1d(np.arange(len(tracks.number)), drop))
    return out, tracks, next_, before


def box_tracker(dets: DataFrame, p: Boxes | None = None, vector: str | None = None, look: Look | None = None, key: str | None = None, seconds: float | None = None) -> DataFrame:
    """``tracklet_id, frame, t, x_m, y_m, det_idx`` (and ``key``): sure detections first, unsure ones for tracks that are left.

    ``vector`` names a column of looks (array or null), which counts only with ``look``.
    Rows without a track are left out. With ``seconds`` a group is a piece of a match,
    and the tracks are the same (``handover``).
    """
    from .tracking import _told, run_tracker

    p = p or Boxes()
    if look is not None and vector is None:
        raise ValueError("the look needs a column of vectors")
    width = (dets.agg(F.max(F.size(vector))).first()[0] or 1) if look is not None else 0
    width = max(width, 1) if look is not None else 0

    def read(state: np.ndarray | None, g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        looks = None
        if look is not None:
            looks = np.array([np.full(width, np.nan) if v is None else np.asarray(v, float) for v in g[vector]]).reshape(len(g), width)
        start = _restored(state, width)
        given = len(start[0].number)
        mine, tracks, next_, before = _followed(start, *(g[c].to_numpy() for c in ("frame", "t")), g[["x1", "y1", "x2", "y2"]].to_numpy(float), g["conf"].to_numpy(float), p, looks, look)
        after, left = _kept(tracks, before, p)
        return _told(mine, given), _told(left, given), next_ - 1 - given, after

    return run_tracker(dets, read, 1, key, seconds)
