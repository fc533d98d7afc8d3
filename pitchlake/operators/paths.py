"""Cheapest paths through candidates along time, a match in many tasks.

A path takes at most one candidate of a frame and may be out of sight. What the
past means for the rest of a path is the cost of being out of sight and of each
candidate within the window, relative to the first: that is the state which
``handover`` hands from segment to segment. Then each segment knows for each state
after it which state before it the path came from; a tree with ``fan`` members a
node follows these maps from the end, and each segment picks its rows.

Costs are rounded to multiples of 2**-30, so that sums do not depend on where they
begin. A task holds a segment or ``fan`` maps, never a match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import handover
from .lineage import saved

#: Parts of a unit of cost.
_UNIT = 2.0**30


@dataclass(frozen=True)
class Chain:
    """The costs of a path. Least cost wins, then least ``tie``, then the first.

    window_s: how long a path may be out of sight and still go on from a candidate.
    move: cost from candidates to one of a later frame by seconds, offsets and frames between; never negative, infinite where not allowed.
    enter: cost of a candidate after being out of sight; stay: cost of a frame out of sight.
    own: what a candidate itself costs, by its row number; tie: what it adds to the tie, by its place in the frame.
    folded: a path may be out of sight in the same frame in which it took a candidate.
    """

    window_s: float
    move: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    enter: float
    stay: tuple[float, float]
    place: tuple[str, str]
    own: str | None = None
    tie: Callable[[int], float] | None = None
    folded: bool = False


def _whole(cost: np.ndarray | float) -> np.ndarray:
    return np.round(np.asarray(cost, float) * _UNIT) / _UNIT


def _first_least(cost: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """For each column the first option of least cost, then least tie."""
    return np.where(cost == cost.min(0), tie, np.inf).argmin(0)


@dataclass
class _Run:
    """A reading of a segment. Candidates are numbered: first those of the state it starts from, then its rows; -1 is out of sight.

    back: where each candidate came from; none_back: where being out of sight after each frame came from;
    left: the candidates of the state after it; state: out of sight costs nothing there.
    """

    back: np.ndarray
    none_back: np.ndarray
    frame_of: np.ndarray
    given: int
    left: np.ndarray
    state: np.ndarray
    best: int

    def came_from(self, ends: np.ndarray) -> np.ndarray:
        """The states before (0: out of sight, else a candidate's place and 1) from which paths came to these ends."""
        out, at, none = np.zeros(len(self.back) + 1, int), self.given, 0
        out[: self.given] = np.arange(self.given) + 1
        nones = np.zeros(len(self.none_back) + 1, int)
        for k, count in enumerate(np.bincount(self.frame_of[self.given :], minlength=len(self.none_back)).tolist()):
            back = self.back[at : at + count]
            out[at : at + count] = np.where(back < 0, nones[k], out[back])
            at += count
            none = self.none_back[k]
            nones[k + 1] = nones[k] if none < 0 else out[none]
        return np.where(ends < 0, nones[-1], out[ends])

    def taken(self, at: int) -> list[int]:
        """The rows on the path to an end, last first."""
        rows: list[int] = []
        k = len(self.none_back) - 1
        while True:
            if at >= self.given:
                rows.append(at - self.given)
                k, at = int(self.frame_of[at]) - 1, int(self.back[at])
            elif at >= 0 or k < 0:
                return rows
            else:
                at = int(self.none_back[k])
                k -= 1


def _read(chain: Chain, state: np.ndarray | None, g: pd.DataFrame) -> _Run:
    """``g``: rows in order. A state has for each candidate: time, place, frames ago, cost and tie."""
    given = np.zeros((0, 6)) if state is None else np.asarray(state, float).reshape(-1, 6)
    m, n = len(given), len(g)
    xy, t = np.r_[given[:, 1:3], g[list(chain.place)].to_numpy(float)], np.r_[given[:, 0], g["t"].to_numpy(float)]
    own = _whole(g[chain.own].to_numpy(float)) if chain.own else np.zeros(n)
    starts = np.flatnonzero(np.diff(g["frame"].to_numpy(), prepend=np.nan) != 0) if n else np.zeros(0, int)
    edges = [*(starts + m).tolist(), n + m]
    frame_of = np.r_[-given[:, 3], np.repeat(np.arange(len(starts)), np.diff(edges))].astype(int)
    cost, tie = np.r_[given[:, 4], np.zeros(n)], np.r_[given[:, 5], np.zeros(n)]
    back, none_back = np.full(m + n, -1), np.full(len(starts), -1)
    none, none_tie = 0.0, 0.0
    enter, (stay, stay_tie) = float(_whole(chain.enter)), (float(_whole(chain.stay[0])), chain.stay[1] if chain.tie else 0.0)
    # latest frames first, candidates of a frame in their order
    near = [np.flatnonzero(frame_of[:m] == f) for f in np.unique(frame_of[:m])[::-1]]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        now = t[a]
        while near and now - t[near[-1][0]] > chain.window_s:
            near.pop()
        prev = np.concatenate(near) if near else np.zeros(0, int)
        prev = prev[cost[prev] <= none + enter]  # others lose to a new start
        rows = np.arange(a, b)
        off = (xy[prev][:, None] - xy[None, a:b]).reshape(-1, 2)
        dt, between = np.repeat(now - t[prev], b - a), np.repeat(k - frame_of[prev] - 1, b - a)
        moved = cost[prev][:, None] + (_whole(chain.move(dt, off, between)).reshape(len(prev), b - a) if len(prev) else np.zeros((0, b - a)))
        options = np.concatenate([np.full((1, b - a), none + enter), moved])
        ties = np.r_[none_tie, tie[prev]]
        at = _first_least(options, ties[:, None])
        cost[a:b] = options[at, np.arange(b - a)] + own[a - m : b - m]
        tie[a:b] = ties[at] + (np.array([chain.tie(i) for i in range(b - a)]) if chain.tie else 0.0)
        back[a:b] = np.r_[-1, prev][at]
        seen = rows if chain.folded else np.flatnonzero(frame_of == k - 1) if k == 0 else np.arange(edges[k - 1], a)
        at = int(_first_least(np.r_[none, cost[seen]], np.r_[none_tie, tie[seen]]))
        none_back[k] = np.r_[-1, seen][at]
        none, none_tie = np.r_[none, cost[seen]][at] + stay, np.r_[none_tie, tie[seen]][at] + stay_tie
        near.insert(0, rows)
    # what the frames to come can see
    left = np.sort(np.concatenate([f for f in near if t[near[0][0]] - t[f[0]] <= chain.window_s])) if near else np.zeros(0, int)
    after = np.column_stack([t[left], xy[left], len(starts) - frame_of[left], cost[left] - none, np.where(np.isfinite(cost[left]), tie[left] - none_tie, 0.0)])
    last = np.zeros(0, int) if chain.folded or not near else near[0]
    best = int(np.r_[-1, last][int(_first_least(np.r_[none, cost[last]], np.r_[none_tie, tie[last]]))])
    return _Run(back, none_back, frame_of, m, left, after.ravel(), best)


def _tree(tables: DataFrame, key: list[str], fan: int, count: int, product: Callable, walk: Callable, start: list[float]) -> DataFrame:
    """``key, n, v`` for each segment, v being what ``walk`` hands to it; at the top it starts from ``start``.

    product: the table of some tables in order; walk: from what is handed to them all, what is handed to each.
    """
    schema = tables.select(*key, "n", "ins", "v").schema
    given = tables.select(*key, "n", "v").schema
    levels, size = [tables.select(*key, "n", "ins", "v")], count

    def up(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        ins, v = product([(int(i), np.asarray(v, float)) for i, v in zip(g["ins"], g["v"], strict=True)])
        return pd.DataFrame([(*k, ins, v.ravel().tolist())], columns=schema.names)

    def down(k: tuple, g: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        handed = walk([(int(i), np.asarray(v, float)) for i, v in zip(g["ins"], g["v"], strict=True)], np.asarray(h["v"].iloc[0], float))
        return pd.DataFrame([(*k[:-1], n, v.ravel().tolist()) for n, v in zip(g["n"], handed, strict=True)], columns=given.names)

    group = F.floor(F.col("n") / fan).cast("int").alias("n")
    while size > fan:
        levels.append(levels[-1].groupBy(*key, group).applyInPandas(up, schema))
        size = -(-size // fan)
    handed = levels[-1].select(*key, F.lit(0).alias("n"), F.lit(start).cast("array<double>").alias("v")).distinct()
    for level in reversed(levels):
        handed = level.groupBy(*key, group).cogroup(handed.groupBy(*key, "n")).applyInPandas(down, given)
    return handed


def _composed(maps: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    out = None
    for _, m in reversed(maps):
        out = m if out is None else m[out.astype(int)]
    return 0, out


def _ends(maps: list[tuple[int, np.ndarray]], end: np.ndarray) -> list[np.ndarray]:
    out, at = [], end
    for _, m in reversed(maps):
        out.append(at)
        at = m[at.astype(int)]
    return out[::-1]


def cheapest(cands: DataFrame, chain: Chain, order: str, seconds: float | None = 60.0, fan: int = 16, key: list[str] | None = None) -> DataFrame:
    """The rows of ``cands`` (``frame, t`` and what ``chain`` needs) on the cheapest path of each ``key``.

    order: orders the candidates of a frame, which it tells apart. Equal to one reading
    of the whole match, which is what no ``seconds`` give. ``seconds`` are at least twice
    the window.
    """
    key = key or []
    by, columns = ["frame", order], cands.columns
    if seconds is None:
        def whole(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(by).reset_index(drop=True)
            run = _read(chain, None, g)
            return g.loc[run.taken(run.best)[::-1]]

        return cands.groupBy(*key).applyInPandas(whole, cands.schema)
    if seconds < 2 * chain.window_s:
        raise ValueError("a segment must last at least twice the window")
    parts = handover.pieces(cands, seconds, seconds / 2, key)
    states = settled(parts, chain, by, key)
    count = (states.agg(F.max("_n")).first()[0] or 0) + 1
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*key).schema)
    kinds = f"{kinds}, " if kinds else ""

    def ways(k: tuple, g: pd.DataFrame, s: pd.Series) -> pd.DataFrame:
        run = _read(chain, s["start"], g)
        ends = np.array([run.best]) if g["_last"].iloc[0] else np.r_[-1, run.left]
        return pd.DataFrame([(*k, 0, run.came_from(ends).astype(float).tolist())], columns=[*key, "n", "ins", "v"])

    maps = saved(handover.from_start(parts, states, ways, f"{kinds}n int, ins int, v array<double>", by, key))
    ends = _tree(maps, key, fan, count, _composed, _ends, [0.0]).select(*key, F.col("n").alias("_n"), F.get("v", F.lit(0)).cast("int").alias("_end"))
    known = states.join(ends.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(key)} | {"_n": "_m"}), [F.col("_n") == F.col("_m"), *(states[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key))])
    known = saved(known.select(*key, "_n", "start", "_end"))

    def pick(k: tuple, g: pd.DataFrame, s: pd.Series) -> pd.DataFrame:
        run = _read(chain, s["start"], g)
        at = run.best if g["_last"].iloc[0] else int(np.r_[-1, run.left][s["_end"]])
        return g[columns].iloc[run.taken(at)[::-1]]

    return handover.from_start(parts, known, pick, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cands.schema), by, key)


def settled(parts: DataFrame, chain: Chain, order: list[str], key: list[str]) -> DataFrame:
    """The state in which each segment starts."""
    return handover.settled(parts, lambda s, g: _read(chain, s, g).state, order, key)
