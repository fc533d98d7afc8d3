"""What reviews of a processed match ask for: windows, phases, oracles, comparisons, catalogues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from . import handover, islands, metrics


def worst_windows(rows: DataFrame, n: int = 3, size_s: int = 30, step_s: int = 5, key: list[str] | None = None) -> DataFrame:
    """The windows with fewest detections a frame that do not overlap each other, the worst first, in each match of ``key``. Windows of a match are some hundreds."""
    windows = metrics.sliding_windows(rows, size_s, step_s, key).select(*(key or []), "start_s", (F.col("n") / F.col("frames")).alias("rate"))

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        chosen: list[int] = []
        for s in g.sort_values(["rate", "start_s"])["start_s"]:
            if len(chosen) < n and all(abs(s - c) >= size_s for c in chosen):
                chosen.append(s)
        return g[g["start_s"].isin(chosen)]

    return windows.groupBy(*(key or [])).applyInPandas(pick, windows.schema)


def play_score(track: DataFrame, size_s: int = 60, step_s: int = 10, key: list[str] | None = None) -> DataFrame:
    """Windows by continuous play: share of frames with a ball, times its mean speed capped at 10 m/s."""
    w = W.partitionBy(*(key or [])).orderBy("frame")
    s = track.withColumn("v", F.sqrt((F.col("mx") - F.lag("mx").over(w)) ** 2 + (F.col("my") - F.lag("my").over(w)) ** 2) / (F.col("t") - F.lag("t").over(w)))
    last, first = F.floor(F.col("t") / step_s), F.floor((F.col("t") - size_s) / step_s) + 1
    each = s.select(*(key or []), "v", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("k"))
    return each.groupBy(*(key or []), (F.col("k") * step_s).cast("bigint").alias("start_s")).agg(F.count("*").alias("n"), fn.rounded(F.avg(F.least("v", F.lit(10.0))), 5).alias("mean_v"))


def phases(rows: DataFrame, step: int, phase: int) -> DataFrame:
    """One of the subsamples of a table: frames with a given remainder."""
    return rows.where(F.col("frame") % step == phase)


def sub_match(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows on the frames that an evaluation uses."""
    return rows.join(frames.select("frame").distinct(), "frame", "left_semi")


def oracle(rows: DataFrame, gt: DataFrame, pairs: DataFrame, what: str) -> DataFrame:
    """Rows with one thing taken from the truth they match: ``position``, ``team`` or ``identity``."""
    t = pairs.join(gt.select("frame", F.col("obj_id").alias("gt_id"), F.col("x_m").alias("gx"), F.col("y_m").alias("gy"), F.col("team").alias("g_team")), ["frame", "gt_id"]).select("frame", F.col("pred_id").alias("obj_id"), "gt_id", "gx", "gy", "g_team")
    j = rows.join(t, ["frame", "obj_id"], "left")
    take = {"position": {"x_m": F.coalesce("gx", "x_m"), "y_m": F.coalesce("gy", "y_m")}, "team": {"team": F.coalesce("g_team", "team")}, "identity": {"obj_id": F.coalesce("gt_id", "obj_id")}}[what]
    return j.withColumns(take).select(*rows.columns)


def team_error(pairs: DataFrame, gt: DataFrame, rows: DataFrame) -> DataFrame:
    """Shares of truths of a team: unmatched, sent to neither team, in the wrong team (A and B as they agree more)."""
    t = gt.select("frame", F.col("obj_id").alias("gt_id"), fn.team_group(F.col("team")).alias("truth")).where("truth is not null")
    p = rows.select("frame", F.col("obj_id").alias("pred_id"), fn.team_group(F.col("team")).alias("said"))
    m = t.join(pairs.join(p, ["frame", "pred_id"]).withColumn("hit", F.lit(True)), ["frame", "gt_id"], "left")
    one = lambda c: F.count(F.when(c, 1))
    both = F.col("said").isNotNull()
    s = m.agg(F.count("*").alias("n"), one(F.col("hit").isNull()).alias("unmatched"), one(F.col("hit") & ~both).alias("other"), one(both & (F.col("said") != F.col("truth"))).alias("x"), one(both & (F.col("said") == F.col("truth"))).alias("y"))
    return s.select("n", fn.rounded(F.col("unmatched") / F.col("n")).alias("unmatched"), fn.rounded(F.col("other") / F.col("n")).alias("other"), fn.rounded(F.least("x", "y") / F.col("n")).alias("wrong"))


def reappearance(gt: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each truth the first frame without a match, and the first match after it."""
    m = gt.select("frame", "obj_id").join(pairs.select("frame", F.col("gt_id").alias("obj_id"), F.lit(1).alias("hit")), ["frame", "obj_id"], "left")
    lost = m.groupBy("obj_id").agg(F.min(F.when(F.col("hit").isNull(), F.col("frame"))).alias("lost"))
    return m.join(lost, "obj_id").groupBy("obj_id", "lost").agg(F.min(F.when((F.col("frame") > F.col("lost")) & F.col("hit").isNotNull(), F.col("frame"))).alias("back"))


def score_inversions(cands: DataFrame, selected: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Candidates surer than the chosen ball nearest in time to them."""
    near = islands.nearest_in_time(cands.select("frame", "cand_idx", "t", "conf"), selected.select("t", "conf"), tolerance_s, keep=["conf"])
    known = near.where("r_conf is not null")
    return known.agg(F.count("*").alias("n"), F.count(F.when(F.col("conf") > F.col("r_conf"), 1)).alias("inversions"))


def readmitted_flights(track: DataFrame, most_s: float = 2.5, key: list[str] | None = None) -> DataFrame:
    """Aerial runs that leave the ground and come back in time; others stay out. ``track`` has ``aerial``."""
    k = ["_k", *(key or [])]
    one = islands.runs(track.withColumn("_k", F.lit(0)), k, "frame", F.col("aerial"))
    ends = one.groupBy(*k).agg(F.max("run").alias("last"))
    by = one.groupBy(*k, "run", "aerial").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).join(F.broadcast(ends), k)
    ok = by.where(F.col("aerial") & (F.col("run") > 1) & (F.col("run") < F.col("last")) & (F.col("t1") - F.col("t0") <= most_s))
    return one.join(ok.select(*k, "run", F.lit(True).alias("back")), [*k, "run"], "left").withColumn("readmitted", F.coalesce("back", F.lit(False))).select(*track.columns, "readmitted")


def field_prior(cands: DataFrame, length: float, width: float, margin: float = 3.0, v_max: float = 35.0, key: str | None = None, seconds: float | None = None) -> DataFrame:
    """Candidates on the pitch and within reach of the last frame's; a frame where none is keeps all it has.

    With ``seconds`` a group is a piece of a match, and the candidates are the same (``handover``).
    """
    order, columns = ["frame", "cand_idx"], cands.columns

    def read(state: np.ndarray | None, g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The rows kept, and the time and places of the last frame that had any within reach."""
        last = None if state is None or not len(state) else (float(state[0]), np.asarray(state[1:], float).reshape(-1, 2))
        times, places, keep = g["t"].to_numpy(float), g[["mx", "my"]].to_numpy(float), np.ones(len(g), bool)
        for rows in np.split(np.arange(len(g)), np.flatnonzero(np.diff(times)) + 1) if len(g) else []:
            t, xy = times[rows[0]], places[rows]
            ok = (xy[:, 0] >= -margin) & (xy[:, 0] <= length + margin) & (xy[:, 1] >= -margin) & (xy[:, 1] <= width + margin)
            if last is not None:
                ok &= np.linalg.norm(xy[:, None] - last[1][None], axis=2).min(1) <= v_max * (t - last[0]) + margin
            if ok.any():
                keep[rows], last = ok, (t, xy[ok])
        return keep, np.zeros(0) if last is None else np.r_[last[0], last[1].ravel()]

    own = [key] if key else []
    if seconds is not None:
        parts = handover.pieces(cands, seconds, seconds / 2, own)
        states = handover.settled(parts, lambda s, g: read(s, g)[1], order, own)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cands.schema)
        return handover.from_start(parts, states, lambda k, g, s: g[columns][read(s["start"], g)[0]], schema, order, own)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["t"].notna()].sort_values(order)
        return g[read(None, g)[0]]

    return cands.groupBy(*own).applyInPandas(run, cands.schema)


def scaled_windows(rows: DataFrame, base: int = 5, gain: float = 1.0, most: int = 61, key: str = "id_jugador") -> DataFrame:
    """An odd smoothing window for each identity, larger where resolution (``factor``) is worse."""
    by = rows.groupBy(key).agg(F.avg("factor").alias("f"), F.count("*").alias("n"))
    raw = F.bround(base * (1 + gain * F.log1p("f"))).cast("int")
    size = F.greatest(F.lit(base), F.least(raw, F.floor(F.col("n") / 2).cast("int") * 2 - 1, F.lit(most)))
    return by.select(key, (size - F.when(size % 2 == 0, 1).otherwise(0)).alias("window"))


def smooth_ball(track: DataFrame, window: int = 5, gap_s: float = 0.2, key: list[str] | None = None) -> DataFrame:
    """The ball smoothed within continuous stretches on the ground; flights stay as they are. ``track`` has ``aerial``."""
    from .smoothing import moving_average

    w = W.partitionBy(*(key or [])).orderBy("frame")
    cut = F.when((F.col("t") - F.lag("t").over(w) > gap_s) | (F.col("aerial") != F.lag("aerial").over(w)), 1).otherwise(0)
    seg = track.withColumn("_c", cut).withColumn("seg", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    s = moving_average(seg.withColumns({"x_m": F.col("mx"), "y_m": F.col("my"), "es_real": F.lit(1)}), window, [*(key or []), "seg"])
    keep = lambda a, b: F.when(F.col("aerial"), F.col(a)).otherwise(F.col(b))
    return s.withColumns({"bx": keep("mx", "sx"), "by": keep("my", "sy")}).select(*track.columns, "bx", "by")


def prototype_drift(features: DataFrame, segment_frames: int, a: list[float], b: list[float], vector: str = "feat") -> DataFrame:
    """How far each team's mean colour of a segment is from its prototype."""
    from .teams import Prototypes, predict, vector_means

    named = predict(features, Prototypes(a, b), vector, None).withColumn("segment", F.floor(F.col("frame") / segment_frames).cast("int"))
    m = vector_means(named, ["segment", "team"], vector)
    own = F.when(F.col("team") == "A", F.array(*map(F.lit, a))).otherwise(F.array(*map(F.lit, b)))
    d = F.zip_with(F.col(vector), own, lambda x, y: x - y)
    return m.select("segment", "team", fn.rounded(fn.norm(d), 5).alias("away"))


def reweighted(simulated: DataFrame, real: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Simulated rows with weights that give their strata the shares of the real ones."""
    n = lambda df, name: df.groupBy(stratum).agg(F.count("*").alias(name))
    share = n(simulated, "s").join(n(real, "r"), stratum)
    return simulated.join(F.broadcast(share), stratum).withColumn("weight", F.col("r") / F.col("s")).drop("r", "s")


def noisy(dets: DataFrame, share: float, mode: str, seed: int = 0) -> DataFrame:
    """Detections less some: a random share, whole frames, or the surest of each frame."""
    place = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    if mode == "frame":
        return dets.where(place("frame") >= share)
    if mode == "confidence":
        w = W.partitionBy("frame").orderBy(F.desc("conf"), "det_idx")
        return dets.withColumn("_r", F.percent_rank().over(w)).where(F.col("_r") >= share).drop("_r")
    return dets.where(place("frame", "det_idx") >= share)


def missing_calculators(catalogue: dict[str, bool], calculators: set[str]) -> list[str]:
    """Active metrics that nobody calculates; a report must not start with any."""
    return sorted(k for k, active in catalogue.items() if active and k not in calculators)


def dominant_zone(rows: DataFrame, length: float = 100.0) -> DataFrame:
    """The third of the pitch where an identity is most often."""
    zone = F.when(F.col("x_m") < length / 3, "left").when(F.col("x_m") < 2 * length / 3, "middle").otherwise("right")
    n = rows.groupBy("id_jugador", zone.alias("zone")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("id_jugador").orderBy(F.desc("n"), "zone"))).where("r = 1").select("id_jugador", "zone", "n")
