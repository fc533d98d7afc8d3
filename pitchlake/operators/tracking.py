"""From detections to identities: trackers, stitching, merging, cutting.

Trackers carry state from frame to frame, so a match (or a segment of one, named
by ``key``) is one group; scale comes from many matches. Candidate links come
from bucketed range joins; choosing among the links of one match is small work
that runs in that match's group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from . import handover, islands
from .boxes import Boxes, Look, box_tracker  # noqa: F401
from .lineage import saved
from .matching import assign


@dataclass(frozen=True)
class Conservative:
    """Parameters of the conservative tracker."""

    v_max: float = 7.0
    margin: float = 0.8
    ambiguity: float = 0.7
    most_gap_steps: float = 3.0
    least_rows: int = 3


class Track:
    """An open tracklet: its last place and time, and a velocity smoothed 0.6 to 0.4."""

    def __init__(self, number: int, t: float, pos: np.ndarray):
        self.number, self.t, self.pos, self.vel = number, t, pos, np.zeros(2)

    def ahead(self, t: float) -> np.ndarray:
        return self.pos + self.vel * (t - self.t)

    def add(self, t: float, pos: np.ndarray) -> None:
        if t > self.t:
            self.vel = 0.6 * self.vel + 0.4 * (pos - self.pos) / (t - self.t)
        self.t, self.pos = t, pos


@dataclass
class _Seen:
    """An open track of the appearance tracker: its last place and time, its last looks, and the rows that they came from in these rows."""

    number: int
    t: float
    pos: np.ndarray
    looks: list[np.ndarray]
    fresh: list[int]
    _mean: np.ndarray | None = None

    def mean(self) -> np.ndarray:
        if self._mean is None:
            self._mean = np.mean(self.looks, axis=0)
        return self._mean

    def take(self, look: np.ndarray, row: int, most: int) -> None:
        self.looks, self.fresh, self._mean = [*self.looks, look][-most:], [*self.fresh, int(row)][-most:], None


def advance(tracks: list[Track], next_number: int, t: float, pos: np.ndarray, p: Conservative, dt: float) -> tuple[list[Track], int, list[int]]:
    """One frame of the conservative tracker: the tracks left open, the next number, and each detection's tracklet."""
    radius = p.v_max * dt + p.margin
    tracks = [k for k in tracks if t - k.t <= p.most_gap_steps * dt]
    mine = [-1] * len(pos)
    if tracks and len(pos):
        d = np.linalg.norm(np.array([k.ahead(t) for k in tracks])[:, None] - pos[None], axis=2)
        rows, cols = assign(d)
        cost = d[rows, cols]
        taken = ~(cost > radius)
        # where a second choice is about as good: rather end a tracklet than steal
        if d.shape[1] > 1:
            taken &= ~(np.partition(d, 1, axis=1)[rows, 1] < cost + p.ambiguity * radius)
        if d.shape[0] > 1:
            taken &= ~(np.partition(d, 1, axis=0)[1, cols] < cost + p.ambiguity * radius)
        for r, c in zip(rows[taken].tolist(), cols[taken].tolist(), strict=True):
            tracks[r].add(t, pos[c])
            mine[c] = tracks[r].number
    for c in range(len(pos)):
        if mine[c] < 0:
            tracks.append(Track(next_number, t, pos[c]))
            mine[c] = next_number
            next_number += 1
    return tracks, next_number, mine


def _frames(g: pd.DataFrame) -> list[np.ndarray]:
    """Places of each frame's rows in rows that come in order."""
    return np.split(np.arange(len(g)), np.flatnonzero(np.diff(g["frame"].to_numpy())) + 1) if len(g) else []


def _told(numbers: list[int], given: int) -> np.ndarray:
    """Numbers of tracks as ``handover.tracked`` has them: those given at the start negative, new ones from 1."""
    n = np.asarray(numbers, "i8")
    return np.where(n > given, n - given, -n)


def run_tracker(dets: DataFrame, read: handover.Reader | handover.Carrier, least: int, key: str | None, seconds: float | None, load: str | None = None, most: int = 0) -> DataFrame:
    """``tracklet_id, frame, t, x_m, y_m, det_idx`` (and ``key``) of tracks with ``least`` rows. A group is a match, or a piece of ``seconds`` of one."""
    order = ["frame", "det_idx"]
    kind = dets.schema[key].dataType.simpleString() if key else None
    cols = [F.col("tracklet_id"), F.col("frame").cast("int").alias("frame"), F.col("t").cast("double").alias("t"), F.col("mx").cast("double").alias("x_m"), F.col("my").cast("double").alias("y_m"), F.col("det_idx").cast("int").alias("det_idx"), *([F.col(key)] if key else [])]
    if seconds is not None:
        rows = handover.tracked(dets, read, seconds, seconds / 2, order, ["frame", "t", "mx", "my", "det_idx"], key, load, most).select(*cols)
        if least <= 1:
            return rows
        rows = saved(rows)
        by = ["tracklet_id", *([key] if key else [])]
        enough = rows.groupBy(*by).agg(F.count("*").alias("_c")).where(F.col("_c") >= least).drop("_c").withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
        return rows.join(enough, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], "left_semi")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["t"].notna()].sort_values(order)
        mine = read(None, g)[0]
        got = pd.DataFrame({"tracklet_id": mine, "frame": g["frame"].to_numpy(), "t": g["t"].to_numpy(), "x_m": g["mx"].to_numpy(), "y_m": g["my"].to_numpy(), "det_idx": g["det_idx"].to_numpy()})
        got = got[(got["tracklet_id"] > 0) & (got.groupby("tracklet_id")["frame"].transform("size") >= least)]
        got = got.astype({"tracklet_id": "int32", "frame": "int32", "det_idx": "int32"})
        return got.assign(**{key: g[key].iloc[0] if len(g) else None}) if key else got

    schema = "tracklet_id int, frame int, t double, x_m double, y_m double, det_idx int" + (f", {key} {kind}" if key else "")
    return dets.groupBy(*([key] if key else [])).applyInPandas(run, schema)


def conservative_tracker(dets: DataFrame, dt: float, p: Conservative | None = None, key: str | None = None, seconds: float | None = None) -> DataFrame:
    """``tracklet_id, frame, t, x_m, y_m, det_idx``: pure but short tracklets. Frames without detections end none by themselves.

    With ``seconds`` a group is a piece of a match, and the tracks are the same (``handover``).
    """
    p = p or Conservative()

    def read(state: np.ndarray | None, g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        given = np.zeros((0, 5)) if state is None else state.reshape(-1, 5)
        tracks = [Track(i + 1, r[0], r[1:3]) for i, r in enumerate(given)]
        for k, r in zip(tracks, given, strict=True):
            k.vel = r[3:5]
        number, mine = len(given) + 1, []
        t, pos = g["t"].to_numpy(float), g[["mx", "my"]].to_numpy(float)
        for rows in _frames(g):
            tracks, number, found = advance(tracks, number, t[rows[0]], pos[rows], p, dt)
            mine += found
        if len(g):
            tracks = [k for k in tracks if t[-1] - k.t <= p.most_gap_steps * dt]
        left = np.array([(k.t, *k.pos, *k.vel) for k in tracks]).reshape(-1, 5)
        order = np.lexsort(left.T[::-1])
        return _told(mine, len(given)), _told([tracks[i].number for i in order], len(given)), number - 1 - len(given), left[order].ravel()

    return run_tracker(dets, read, p.least_rows, key, seconds)


def appearance_tracker(dets: DataFrame, buffer_s: float = 1.5, confirm: int = 2, open_conf: float = 0.1, signatures: int = 8, key: str | None = None, seconds: float | None = None) -> DataFrame:
    """A tracker by the mixed cost of place and appearance (``emb``: array or null); a track's look is the mean of its last vectors.

    With ``seconds`` a group is a piece of a match, and the tracks are the same (``handover``).
    """
    def read(state: np.ndarray | None, g: pd.DataFrame, loads: list | None = None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, list[list[int]], list[int]]:
        state = np.zeros((0, 3)) if state is None else state.reshape(-1, 3)
        given = len(state)
        tracks = [_Seen(i + 1, r[0], r[1:], [np.asarray(v[0], float) for v in (loads[i] if loads else ())], []) for i, r in enumerate(state)]
        number, out, asked = given + 1, [], set()
        times, places, confs, embs = g["t"].to_numpy(float), g[["mx", "my"]].to_numpy(float), g["conf"].to_numpy(float), g["emb"].tolist()
        seen, sigmas = np.array([len(v) > 0 for v in embs], bool), np.clip(0.11 + 0.026 * places[:, 1], 0.11, 1.85)
        for rows in _frames(g):
            t, pos = times[rows[0]], places[rows]
            tracks = [k for k in tracks if t - k.t <= buffer_s]
            known = np.flatnonzero(seen[rows])
            looks = {int(j): np.asarray(embs[rows[j]][0], float) for j in known}
            mine = [0] * len(pos)
            if tracks:
                gap = np.array([t - k.t for k in tracks])[:, None]
                sigma = sigmas[rows]
                radius = 7.0 * gap + 2.0 * sigma
                apart = np.array([k.pos for k in tracks])[:, None] - pos[None]
                away = np.hypot(apart[..., 0], apart[..., 1])
                near = away <= radius
                cost = np.where(near, away / np.maximum(radius, 1e-9), 1e6)
                met = np.flatnonzero(near[:, known].any(axis=1)) if len(known) else ()
                asked |= {tracks[i].number for i in met if tracks[i].number <= given and len(tracks[i].fresh) < signatures}
                met = [i for i in met if tracks[i].looks]
                if met:
                    at = np.ix_(met, known)
                    geometry = 1 / np.maximum(sigma[known] ** 2 + (1.5 * gap[met]) ** 2, 1e-9)
                    m, v = np.array([tracks[i].mean() for i in met]), np.array(list(looks.values()))
                    unlike = 1 - m @ v.T / ((np.linalg.norm(m, axis=1) + 1e-9)[:, None] * (np.linalg.norm(v, axis=1) + 1e-9))
                    cost[at] = np.where(near[at], (geometry * cost[at] + np.fmin(1.0, unlike)) / (geometry + 1), cost[at])
                for r, c in zip(*assign(cost), strict=True):
                    if cost[r, c] < 1e6:
                        mine[c] = tracks[r].number
                        tracks[r].t, tracks[r].pos = t, pos[c]
                        if c in looks:
                            tracks[r].take(looks[c], rows[c], signatures)
            for c, conf in enumerate(confs[rows]):
                if not mine[c] and conf >= open_conf:
                    tracks.append(_Seen(number, t, pos[c], [], []))
                    if c in looks:
                        tracks[-1].take(looks[c], rows[c], signatures)
                    mine[c] = number
                    number += 1
            out += mine
        if len(g):
            tracks = [k for k in tracks if times[-1] - k.t <= buffer_s]
        left = np.array([(k.t, *k.pos) for k in tracks]).reshape(-1, 3)
        order = np.lexsort(left.T[::-1])
        tracks = [tracks[i] for i in order]
        return _told(out, given), _told([k.number for k in tracks], given), number - 1 - given, left[order].ravel(), [k.fresh for k in tracks], sorted(n - 1 for n in asked)

    # on its way to Python a column of arrays takes, for each null, time by the nulls before it; an empty array does not
    dets = dets.select(*([key] if key else []), "frame", "t", "det_idx", "mx", "my", "conf", F.filter(F.array("emb"), F.isnotnull).alias("emb"))
    return run_tracker(dets, read, confirm, key, seconds, "emb", signatures)


def summaries(obs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Tracklets as rows: first and last time and place, and the smoothed velocity at the end; ``key``: columns of their match."""
    own = key or []
    ordered = F.array_sort(F.collect_list(F.struct("t", "x_m", "y_m")))
    by = obs.groupBy(*own, "tracklet_id").agg(ordered.alias("o"))

    def step(acc, p):
        dt = p["t"] - acc["t"]
        v = lambda c: F.when(dt > 0, 0.6 * acc[f"v{c}"] + 0.4 * (p[f"{c}_m"] - acc[c]) / dt).otherwise(acc[f"v{c}"])
        return F.struct(p["t"].alias("t"), p["x_m"].alias("x"), p["y_m"].alias("y"), v("x").alias("vx"), v("y").alias("vy"))

    first = F.get("o", F.lit(0))
    start = F.struct(first["t"].alias("t"), first["x_m"].alias("x"), first["y_m"].alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    end = F.aggregate(F.slice("o", F.lit(2), F.greatest(F.size("o") - 1, F.lit(1))), start, step)
    return by.select(*own, "tracklet_id", first["t"].alias("t0"), first["x_m"].alias("x0"), first["y_m"].alias("y0"), end.alias("e"), F.size("o").alias("n")).select(*own, "tracklet_id", "t0", F.col("e.t").alias("t1"), "x0", "y0", F.col("e.x").alias("x1"), F.col("e.y").alias("y1"), F.col("e.vx").alias("vx"), F.col("e.vy").alias("vy"), "n")


def stitch_candidates(tracklets: DataFrame, max_gap: float = 6.0, tol: float = 1.2, tol_per_s: float = 3.0, gap_weight: float = 0.3, v_max: float | None = None, colour: str | None = None, label: str | None = None, most_colour: float = 1.2, colour_weight: float = 0.15, speed_weight: float = 0.0, v_ref: float = 7.0, key: list[str] | None = None) -> DataFrame:
    """Links (a, b) that motion allows, with a cost of distance over tolerance and of the gap.

    ``colour`` names a column of mean colour vectors: links further apart than
    ``most_colour`` are out, the others pay for their distance. ``label`` names a
    column of team labels: two different ones are out. A null on either side
    abstains. ``speed_weight`` prices the change from the velocity before the gap
    to that of the jump, in units of ``v_ref``. ``key``: columns of the match, which
    both ends share and links keep; tracklets are unique over matches.
    """
    own = key or []
    pairs = islands.range_candidates(tracklets, max_gap, own)
    gap = F.col("gap")
    # the optimizer may test speeds before the gap: no division by a gap of 0
    some = F.nullif(gap, F.lit(0.0))
    away = F.sqrt((F.col("a_x1") + F.col("a_vx") * gap - F.col("b_x0")) ** 2 + (F.col("a_y1") + F.col("a_vy") * gap - F.col("b_y0")) ** 2)
    jump = F.sqrt((F.col("b_x0") - F.col("a_x1")) ** 2 + (F.col("b_y0") - F.col("a_y1")) ** 2) / some
    ok = away <= tol + tol_per_s * gap
    if v_max is not None:
        ok = ok & (jump <= v_max)
    cost = away / (tol + tol_per_s * gap) + gap_weight * gap / max_gap
    if label is not None:
        ok = ok & F.coalesce(F.col(f"a_{label}") == F.col(f"b_{label}"), F.lit(True))
    if colour is not None:
        apart = F.sqrt(F.aggregate(F.zip_with(f"a_{colour}", f"b_{colour}", lambda x, y: (x.cast("double") - y) ** 2), F.lit(0.0), lambda s, d: s + d))
        ok = ok & F.coalesce(apart <= most_colour, F.lit(True))
        cost = cost + colour_weight * F.coalesce(apart / most_colour, F.lit(0.0))
    if speed_weight > 0:
        turn = F.sqrt(((F.col("b_x0") - F.col("a_x1")) / some - F.col("a_vx")) ** 2 + ((F.col("b_y0") - F.col("a_y1")) / some - F.col("a_vy")) ** 2)
        cost = cost + speed_weight * turn / v_ref
    return pairs.where(ok).select(*(F.col(f"a_{c}").alias(c) for c in own), F.col("a_tracklet_id").alias("a"), F.col("b_tracklet_id").alias("b"), "gap", jump.alias("speed"), cost.alias("cost"))


def choose_links(candidates: DataFrame, how: str = "greedy", dummy: float = 2.0, key: str | None = None) -> DataFrame:
    """At most one successor and one predecessor for each tracklet: cheapest first, or least total cost where leaving one alone costs ``dummy``."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["cost", "a", "b"])
        if how == "greedy":
            has, is_, keep = set(), set(), []
            for a, b in g[["a", "b"]].itertuples(index=False):
                keep.append(a not in has and b not in is_)
                if keep[-1]:
                    has.add(a)
                    is_.add(b)
            return g[np.array(keep, bool)][["a", "b", "cost"]]
        # links that share no tracklet are apart: solve each component by itself
        parent: dict = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in g[["a", "b"]].itertuples(index=False):
            parent[root(("a", a))] = root(("b", b))
        out = []
        for _, part in g.groupby(np.array([str(root(("a", a))) for a in g["a"]], object)):
            left, right = sorted(set(part["a"])), sorted(set(part["b"]))
            cost = np.full((len(left), len(right) + len(left)), 1e6)
            cost[np.arange(len(left)), len(right) + np.arange(len(left))] = dummy
            row, column = {a: i for i, a in enumerate(left)}, {b: j for j, b in enumerate(right)}
            for a, b, c in part[["a", "b", "cost"]].itertuples(index=False):
                cost[row[a], column[b]] = c
            for r, c in zip(*assign(cost), strict=True):
                if c < len(right) and cost[r, c] < 1e6:
                    out.append((left[r], right[c], cost[r, c]))
        return pd.DataFrame(out, columns=["a", "b", "cost"])

    kind = candidates.schema["a"].dataType.simpleString()
    return candidates.groupBy(*([key] if key else [])).applyInPandas(run, f"a {kind}, b {kind}, cost double")


def mutual_best(candidates: DataFrame, ambiguity: float = 0.15) -> DataFrame:
    """Links that are the cheapest both ways, unless the second choice is nearly as cheap."""
    f, b = W.partitionBy("a").orderBy("cost", "b"), W.partitionBy("b").orderBy("cost", "a")
    ranked = candidates.withColumns({"rf": F.row_number().over(f), "rb": F.row_number().over(b), "nf": F.lead("cost").over(f), "nb": F.lead("cost").over(b)})
    clear = lambda c: F.col(c).isNull() | (F.col(c) > F.col("cost") * (1 + ambiguity))
    return ranked.where((F.col("rf") == 1) & (F.col("rb") == 1) & clear("nf") & clear("nb")).select("a", "b", "cost")


def purity_stitch(obs: DataFrame, passes: int = 3, ambiguity: float = 0.15, max_gap: float = 6.0, v_max: float = 8.0, colour: str | None = None, key: str | None = None) -> DataFrame:
    """Tracklets joined in up to ``passes`` passes of links that are the best both ways: ``tracklet_id, identity_id``.

    In a pass the cheapest links come first, and a tracklet that continues another does
    not go on itself; the next pass sees the joined ones as one, with their mean
    ``colour``. Joined tracklets share no time, so no frame. Links of a match are one group.
    """
    from .teams import vector_means

    def accepted(g: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        keep = []
        for a, b in g.sort_values(["cost", "a", "b"])[["a", "b"]].itertuples(index=False):
            if a not in used and b not in used:
                used.add(b)
                keep.append((a, b))
        return pd.DataFrame(keep, columns=["a", "b"])

    kind, match = obs.schema["tracklet_id"].dataType.simpleString(), [key] if key else None
    names = saved(obs.select("tracklet_id", F.col("tracklet_id").alias("identity_id")).distinct())
    for _ in range(passes):
        named = obs.join(names, "tracklet_id").drop("tracklet_id").withColumnRenamed("identity_id", "tracklet_id")
        tracklets = summaries(named, match)
        if colour is not None:
            tracklets = tracklets.join(vector_means(named.where(F.col(colour).isNotNull()), ["tracklet_id"], colour), "tracklet_id", "left")
        best = mutual_best(stitch_candidates(tracklets, max_gap=max_gap, v_max=v_max, colour=colour, key=match), ambiguity)
        if key is not None:
            best = best.join(named.select(F.col("tracklet_id").alias("a"), key).distinct(), "a")
        links = saved(best.groupBy(*([key] if key else [])).applyInPandas(accepted, f"a {kind}, b {kind}"))
        if links.isEmpty():
            break
        joined = components(names.select(F.col("identity_id").alias("tracklet_id")).distinct(), links).withColumnRenamed("tracklet_id", "through").withColumnRenamed("identity_id", "joined")
        names = saved(names.join(joined, F.col("identity_id") == F.col("through")).select("tracklet_id", F.col("joined").alias("identity_id")))
    return names


def unique_links(candidates: DataFrame) -> DataFrame:
    """Links of tracklets that have one candidate each, both ways."""
    n = candidates.withColumns({"out": F.count("*").over(W.partitionBy("a")), "in_": F.count("*").over(W.partitionBy("b"))})
    return n.where("out = 1 and in_ = 1").drop("out", "in_")


def plausible_links(tracklets: DataFrame, max_gap: float = 3.0, v_max: float = 7.0, k_sigma: float = 2.0) -> DataFrame:
    """Links within reach of a player in the gap and the uncertainty of both ends."""
    pairs = islands.range_candidates(tracklets, max_gap)
    away = F.sqrt((F.col("b_x0") - F.col("a_x1")) ** 2 + (F.col("b_y0") - F.col("a_y1")) ** 2)
    return pairs.where(away <= v_max * F.col("gap") + k_sigma * fn.position_sigma(F.col("b_y0"))).select(F.col("a_tracklet_id").alias("a"), F.col("b_tracklet_id").alias("b"), "gap", away.alias("away"))


def link_funnel(tracklets: DataFrame, max_gap: float = 6.0, v_max: float = 8.0) -> DataFrame:
    """How many candidate links pass one condition after another."""
    pairs = islands.range_candidates(tracklets, max_gap)
    speed = F.sqrt((F.col("b_x0") - F.col("a_x1")) ** 2 + (F.col("b_y0") - F.col("a_y1")) ** 2) / F.col("gap")
    fast = speed <= v_max
    near = F.col("gap") <= max_gap / 2
    one = lambda c: F.count(F.when(c, 1))
    return pairs.agg(F.count("*").alias("in_time"), one(fast).alias("in_speed"), one(fast & near).alias("soon"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``tracklet_id, identity_id``: the least tracklet that links reach. Labels spread and jump until none changes."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both)
    labels = saved(nodes.select("tracklet_id", F.col("tracklet_id").alias("identity_id")))
    while True:
        near = both.join(labels, F.col("b") == F.col("tracklet_id")).groupBy("a").agg(F.min("identity_id").alias("near"))
        moved = labels.join(near, F.col("tracklet_id") == F.col("a"), "left").select("tracklet_id", F.least("identity_id", F.coalesce("near", "identity_id")).alias("label"), "identity_id")
        jump = moved.select(F.col("tracklet_id").alias("label"), F.col("label").alias("beyond"))
        out = saved(moved.join(jump, "label").select("tracklet_id", F.least("label", "beyond").alias("next"), "identity_id"))
        if not out.where("next <> identity_id").limit(1).count():
            return out.select("tracklet_id", F.col("next").alias("identity_id"))
        labels = out.select("tracklet_id", F.col("next").alias("identity_id"))


def duplicates(rows: DataFrame, least_frames: int = 3, most_m: float = 1.5, key: str = "id_jugador") -> DataFrame:
    """Identities that live at the same place at the same time: pairs to merge."""
    return islands.pair_overlap(rows, least_frames, key).where(F.col("median_m") <= most_m).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "shared", fn.rounded(F.col("median_m")).alias("median_m"))


def merge_identities(rows: DataFrame, pairs: DataFrame, key: str = "id_jugador") -> DataFrame:
    """Rows under merged identities, one a frame: that of the identity with most rows."""
    nodes = rows.select(F.col(key).alias("tracklet_id")).distinct()
    named = components(nodes, pairs)
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    w = W.partitionBy("identity_id", "frame").orderBy(F.desc("_n"), key)
    placed = rows.join(sizes, key).join(named, F.col(key) == F.col("tracklet_id")).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return placed.select(*[c for c in rows.columns if c != key], F.col("identity_id").alias(key))


def concurrency(rows: DataFrame, frames: DataFrame, key: str = "id_jugador", match: list[str] | None = None) -> DataFrame:
    """Identities between their first and last frame, at each frame: starts and ends added up, in each match of ``match``."""
    own = match or []
    life = rows.groupBy(*own, key).agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    events = life.select(*own, F.col("a").alias("frame"), F.lit(1).alias("d"), F.lit(0).alias("e")).unionAll(life.select(*own, F.col("b").alias("frame"), F.lit(0).alias("d"), F.lit(1).alias("e")))
    by = frames.select(*own, "frame").distinct().select(*own, "frame", F.lit(0).alias("d"), F.lit(0).alias("e")).unionAll(events).groupBy(*own, "frame").agg(F.sum("d").alias("d"), F.sum("e").alias("e"))
    w = W.partitionBy(*own).orderBy("frame")
    return by.select(*own, "frame", (F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.coalesce(F.sum("e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("active"))


def colour_cuts(votes: DataFrame, least: int = 30, purity: float = 0.85, gain: float = 0.08, side: int = 10) -> DataFrame:
    """Where to split identities whose votes (``id_jugador, frame, equipo``) change sides: the split of highest weighted purity, if it is worth it."""
    w = W.partitionBy("id_jugador").orderBy("frame")
    whole = W.partitionBy("id_jugador")
    s = votes.where(F.col("equipo").isin(0, 1)).withColumns({"i": F.row_number().over(w), "n": F.count("*").over(whole), "a": F.sum(1 - F.col("equipo")).over(w.rowsBetween(W.unboundedPreceding, 0)), "ta": F.sum(1 - F.col("equipo")).over(whole)})
    i, n, a, ta = (F.col(c) for c in ("i", "n", "a", "ta"))
    split = (F.greatest(a, i - a) + F.greatest(ta - a, (n - i) - (ta - a))) / n
    before = F.greatest(ta, n - ta) / n
    ok = (n >= least) & (i >= side) & (n - i >= side)
    best = s.where(ok).withColumns({"split": split, "before": before}).groupBy("id_jugador").agg(F.max("before").alias("before"), F.max_by(F.struct("frame", "split"), F.struct("split", -F.col("frame"))).alias("b"))
    return best.where((F.col("before") < purity) & (F.col("b.split") - F.col("before") >= gain)).select("id_jugador", F.col("b.frame").alias("last_frame"), fn.rounded(F.col("before")).alias("before"), fn.rounded(F.col("b.split")).alias("after"))


def appearance_cuts(rows: DataFrame, window: int = 12, least: float = 0.5, most_cuts: int = 3) -> DataFrame:
    """Change points of a tracklet's vectors (``tracklet_id, frame, emb``): where the means of the windows before and after differ most, again in both parts."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame")
        x, frames = np.array(g["emb"].tolist(), float), g["frame"].to_numpy()

        def unlike(a, b):
            a, b = a.mean(0), b.mean(0)
            return 1 - a @ b / ((np.linalg.norm(a) + 1e-9) * (np.linalg.norm(b) + 1e-9))

        cuts: list[tuple[int, float]] = []
        parts = [(0, len(x))]
        while parts and len(cuts) < most_cuts:
            options = [(unlike(x[i - window : i], x[i : i + window]), i, p) for p in parts for i in range(p[0] + window, p[1] - window + 1)]
            if not options or max(options)[0] < least:
                break
            score, i, p = max(options)
            cuts.append((i, score))
            parts.remove(p)
            parts += [(p[0], i), (i, p[1])]
        return pd.DataFrame({"tracklet_id": np.full(len(cuts), g["tracklet_id"].iloc[0], "int32"), "frame": [int(frames[i]) for i, _ in cuts], "score": [s for _, s in cuts]}).astype({"frame": "int32", "score": "float64"})

    return rows.groupBy("tracklet_id").applyInPandas(run, "tracklet_id int, frame int, score double")


def crossings(dets: DataFrame, least_iou: float = 0.10) -> DataFrame:
    """Runs of frames in which a detection's box overlaps another: candidates for exchanged identities."""
    from .filters import occluded

    return occluded(dets, least_iou).select("frame").distinct()


def interleaved_costs(rows: DataFrame, key: str = "id_jugador", window_s: float | None = None, most_together: int | None = None, apart_m: float | None = None, least_shared: int = 3, t: str = "tiempo_s", only: int | None = None) -> DataFrame:
    """Cost of joining pairs of identities whose rows alternate in time: ``id_a, id_b, shared, cost``.

    Each row is measured against the other identity's place between its rows
    before and after, both ways and never beyond its first and last row. The cost
    is the median of these distances, or with ``window_s`` the largest of the
    medians by window. Pairs seen together on ``most_together`` frames are two
    people and have no cost, nor have those that are more than ``apart_m`` (by
    median) apart on at least ``least_shared`` frames. ``only``: pairs with this
    identity. A line between two rows is dealt to its frames, so frames join.
    """
    w = W.partitionBy(key).orderBy("frame")
    own = rows.select(F.col(key).alias("i"), F.col("frame").alias("f0"), F.col(t).alias("t0"), F.col("x_m").alias("x0"), F.col("y_m").alias("y0"), *(F.lead(c).over(w).alias(n) for c, n in (("frame", "f1"), (t, "t1"), ("x_m", "x1"), ("y_m", "y1"))))
    lines = own.withColumn("on", F.explode(F.sequence("f0", F.greatest(F.col("f0"), F.coalesce(F.col("f1") - 1, F.col("f0"))))))
    seen = rows.select(F.col(key).alias("j"), "frame", F.col(t).alias("at"), "x_m", "y_m")
    met = seen.join(lines, (F.col("frame") == F.col("on")) & (F.col("i") != F.col("j")))
    if only is not None:
        met = met.where((F.col("i") == only) | (F.col("j") == only))
    u = F.when((F.col("at") > F.col("t0")) & (F.col("t1") > F.col("t0")), (F.col("at") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0))).otherwise(0.0)
    along = lambda c: F.when(u == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}0") + u * (F.col(f"{c}1") - F.col(f"{c}0")))
    d = F.sqrt((F.col("x_m") - along("x")) ** 2 + (F.col("y_m") - along("y")) ** 2)
    each = met.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), d.alias("d"), (F.col("frame") == F.col("f0")).alias("both"), (F.col("i") < F.col("j")).alias("first"), F.lit(0).alias("window") if window_s is None else F.floor(F.col("at") / window_s).alias("window"))
    cost = each.groupBy("id_a", "id_b", "window").agg(F.median("d").alias("m"), F.count(F.when(F.col("both") & F.col("first"), 1)).alias("n")).groupBy("id_a", "id_b").agg(F.sum("n").alias("shared"), F.max("m").alias("cost"))
    if most_together is not None:
        cost = cost.where(F.col("shared") < most_together)
    if apart_m is not None:
        apart = each.where("both").groupBy("id_a", "id_b").agg(F.median("d").alias("apart"))
        cost = cost.join(apart, ["id_a", "id_b"], "left").where((F.col("shared") < least_shared) | F.col("apart").isNull() | (F.col("apart") <= apart_m))
    return cost.select("id_a", "id_b", "shared", fn.rounded(F.col("cost")).alias("cost"))


def roster_cap(rows: DataFrame, frames: DataFrame, cap: int, most_cost: float = 2.0, key: str = "id_jugador", window_s: float | None = None, most_together: int | None = 3, apart_m: float | None = None, least_shared: int = 3, t: str = "tiempo_s") -> DataFrame:
    """Identities merged, cheapest pair first, until the median number at once is within the cap or no pair is cheap enough.

    Identities of a match are some hundreds: their pairs' costs are kept here, and
    a merge asks for those of the merged identity only.
    """
    def costs(current: DataFrame, only: int | None = None) -> dict[tuple[int, int], float]:
        found = interleaved_costs(current, key, window_s, most_together, apart_m, least_shared, t, only)
        return {(r["id_a"], r["id_b"]): r["cost"] for r in found.where(F.col("cost") <= most_cost).collect()}

    current, cheap = rows, None
    while True:
        median = concurrency(current, frames, key).agg(F.median("active")).first()[0]
        if median is None or median <= cap:
            return current
        cheap = costs(current) if cheap is None else cheap
        if not cheap:
            return current
        a, b = min(cheap, key=lambda p: (cheap[p], p))
        pair = rows.sparkSession.createDataFrame([(a, b)], "a int, b int")
        current = saved(merge_identities(current, pair, key))
        cheap = {p: c for p, c in cheap.items() if not {a, b} & set(p)} | costs(current, min(a, b))


def fused_boxes(obs: DataFrame, least_jump_m: float = 3.0, growth: float = 1.25) -> DataFrame:
    """Rows where a trajectory jumps while its box is much larger than usual for the whole tracklet."""
    w = W.partitionBy("tracklet_id").orderBy("frame")
    height = F.col("y2") - F.col("y1")
    s = obs.withColumns({"h": height, "usual": F.expr("percentile(y2 - y1, 0.5)").over(W.partitionBy("tracklet_id")), "jump": F.sqrt((F.col("x_m") - F.lag("x_m").over(w)) ** 2 + (F.col("y_m") - F.lag("y_m").over(w)) ** 2)})
    return s.where((F.col("jump") > least_jump_m) & (F.col("h") >= growth * F.col("usual"))).select("tracklet_id", "frame", "jump", "h", "usual")


def fused_cuts(obs: DataFrame, least_jump_m: float = 3.0, most_step_s: float = 0.35, side_s: float = 1.0, least_side: int = 3, usual_s: float = 2.0, taller: float = 1.25, wider: float = 1.5, head_share: float = 0.5, length: float = 100.0, width: float = 64.0, margin_y: float = 1.0, piece_s: float = 60.0) -> DataFrame:
    """Where two people in one box part: rows of ``tracklet_id, frame, t, x_m, y_m, x1, y1, x2, y2`` that begin a new person.

    The step into the row is short in time and jumps; so do the medians of the
    second before and after, by position on the pitch, and the top edge of the box
    moves with its bottom edge (the whole box, not a foot that came into sight); the
    box of the row or of the one before is taller or wider than the median of the
    rows within ``usual_s`` of it, itself left out.

    A group is ``piece_s`` seconds of a tracklet with the rows around that they need;
    medians are taken where a step jumps only. Missing values are in no median.
    """
    us = lambda s: round(s * 1e6)
    piece, side, usual = us(piece_s), us(side_s), us(usual_s)
    # a millisecond more, for times whose difference is rounded
    ahead = max(side, usual) + 1000
    back = ahead + us(most_step_s)
    at = F.round(F.col("t") * 1e6).cast("long")
    numbers = F.sequence(F.floor((at - ahead) / piece), F.floor((at + back) / piece))
    columns = ("t", "x_m", "y_m", "x1", "y1", "x2", "y2")
    parts = obs.where("t is not null").select("tracklet_id", "frame", *(F.col(c).cast("double").alias(c) for c in columns), at.alias("_us"), F.explode(numbers).alias("_n"))

    def middle(rows: np.ndarray) -> np.ndarray:
        """Median of each column."""
        if np.isnan(rows).any():
            return np.array([middle(c[:, None])[0] if len(c := x[~np.isnan(x)]) else np.nan for x in rows.T])
        rows, n = np.sort(rows, axis=0), len(rows)
        return (rows[(n - 1) // 2] + rows[n // 2]) / 2

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_us", "frame"])
        at, t, x, y, x1, y1, x2, y2 = (g[c].to_numpy() for c in ("_us", *columns))
        size = np.c_[y2 - y1, x2 - x1]
        where = np.c_[x, y, (x1 + x2) / 2, y1, y2]
        away = lambda a, b: np.sqrt(((a - b) ** 2).sum(-1))
        own = at[1:] // piece == k[1]
        steps = np.flatnonzero(own & (t[1:] - t[:-1] <= most_step_s) & (away(where[1:, :2], where[:-1, :2]) > least_jump_m)) + 1

        def fused(j: int) -> bool:
            lo, hi = np.searchsorted(at, at[j] - usual), np.searchsorted(at, at[j] + usual, "right")
            rest = np.r_[size[lo:j], size[j + 1 : hi]]
            return len(rest) > 0 and bool((size[j] >= middle(rest) * (taller, wider)).any())

        def parted(i: int) -> bool:
            a = slice(np.searchsorted(at, at[i - 1] - side), np.searchsorted(at, at[i - 1], "right"))
            b = slice(np.searchsorted(at, at[i]), np.searchsorted(at, at[i] + side, "right"))
            if a.stop - a.start < least_side or b.stop - b.start < least_side:
                return False
            a, b = middle(where[a]), middle(where[b])
            if not (0 <= a[0] <= length and -margin_y <= a[1] <= width + margin_y and away(a[:2], b[:2]) > least_jump_m):
                return False
            return bool(away(a[[2, 3]], b[[2, 3]]) >= head_share * away(a[[2, 4]], b[[2, 4]])) and (fused(i) or fused(i - 1))

        return pd.DataFrame({"tracklet_id": k[0], "frame": g["frame"].to_numpy()[[i for i in steps.tolist() if parted(i)]]})

    schema = ", ".join(f"{c} {obs.schema[c].dataType.simpleString()}" for c in ("tracklet_id", "frame"))
    return parts.groupBy("tracklet_id", "_n").applyInPandas(run, schema)


def pruned_embeddings(rows: DataFrame, keys: DataFrame, window: int, least_gap: int) -> DataFrame:
    """Keys (``tracklet_id, frame, det_idx``) near a re-entry, the only ones whose vectors are needed."""
    w = W.partitionBy("tracklet_id").orderBy("frame")
    back = rows.withColumn("_gap", F.col("frame") - F.lag("frame").over(w)).where(F.col("_gap") >= least_gap).select("tracklet_id", F.explode(F.array("frame", F.col("frame") - F.col("_gap"))).alias("_at"))
    near = keys.join(back, (keys["tracklet_id"] == back["tracklet_id"]) & (F.abs(F.col("frame") - F.col("_at")) <= window), "left_semi")
    return near


def reentry_gate(rows: DataFrame, least_gap: int, unlike: float = 0.5, side: int = 8, least: int = 3) -> DataFrame:
    """Where a tracklet comes back looking different: the mean vector of the rows before and after a gap; too few rows abstain."""
    w = W.partitionBy("tracklet_id").orderBy("frame")
    numbered = rows.withColumns({"i": F.row_number().over(w), "gap": F.col("frame") - F.lag("frame").over(w)})
    cuts = numbered.where(F.col("gap") >= least_gap).select("tracklet_id", F.col("i").alias("at"), F.col("frame").alias("cut_frame"))
    near = numbered.join(cuts, "tracklet_id").where((F.col("i") >= F.col("at") - side) & (F.col("i") < F.col("at") + side))
    each = near.select("tracklet_id", "cut_frame", (F.col("i") >= F.col("at")).alias("after"), F.posexplode("emb").alias("k", "v"))
    mean = each.groupBy("tracklet_id", "cut_frame", "after", "k").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    vec = mean.groupBy("tracklet_id", "cut_frame", "after").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("vec"), F.max("n").alias("n"))
    pair = vec.groupBy("tracklet_id", "cut_frame").agg(F.first(F.when(~F.col("after"), F.col("vec")), True).alias("a"), F.first(F.when(F.col("after"), F.col("vec")), True).alias("b"), F.min("n").alias("n"), F.count("*").alias("sides"))
    return pair.where((F.col("sides") == 2) & (F.col("n") >= least) & (fn.cosine_distance(F.col("a"), F.col("b")) > unlike)).select("tracklet_id", "cut_frame")
