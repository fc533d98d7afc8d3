"""Tracking quality against annotated truth (``frame, obj_id, x_m, y_m, team, label``)."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from . import handover, islands
from .lineage import saved
from .matching import FRAMES, identity_map, most_gain


def shared_frames(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Frames that both have."""
    return gt.select("frame").distinct().join(pred.select("frame").distinct(), "frame", "left_semi")


def identity_scores(gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """IDF1 and its parts, recall, precision: ids are mapped once, for most agreeing frames."""
    mapped = identity_map(pairs)
    idtp = mapped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("idtp"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    s = idtp.crossJoin(one(gt, "n_gt")).crossJoin(one(pred, "n_pred")).crossJoin(one(pairs, "matched"))  # four single rows
    return s.select("idtp", (F.col("n_pred") - F.col("idtp")).alias("idfp"), (F.col("n_gt") - F.col("idtp")).alias("idfn"), fn.rounded(2 * F.col("idtp") / (F.col("n_gt") + F.col("n_pred"))).alias("idf1"), fn.rounded(F.col("matched") / F.col("n_gt")).alias("recall"), fn.rounded(F.col("matched") / F.col("n_pred")).alias("precision"))


def switches(gt: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each truth: switches to another id than the last matched, and times it is matched again after not being."""
    w = W.partitionBy("obj_id").orderBy("frame")
    m = gt.select("frame", "obj_id").join(pairs.select("frame", F.col("gt_id").alias("obj_id"), "pred_id"), ["frame", "obj_id"], "left")
    s = m.withColumns({"last": F.last("pred_id", True).over(w.rowsBetween(W.unboundedPreceding, -1)), "before": F.lag("pred_id").over(w)})
    again = F.col("pred_id").isNotNull() & F.col("last").isNotNull()
    return s.groupBy("obj_id").agg(F.count(F.when(again & (F.col("last") != F.col("pred_id")), 1)).alias("switches"), F.count(F.when(again & F.col("before").isNull(), 1)).alias("fragments"))


def fragmentation(pairs: DataFrame) -> DataFrame:
    """Predicted ids of each truth."""
    return pairs.groupBy("gt_id").agg(F.countDistinct("pred_id").alias("ids"), F.count("*").alias("frames"))


def _swap(label: Column) -> Column:
    return F.when(label == "A", "B").when(label == "B", "A").otherwise(label)


def team_accuracy(gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each predicted id the team of most of its truths (of equals the first seen) against the team it first declares."""
    teams = pairs.join(gt.select("frame", F.col("obj_id").alias("gt_id"), "team"), ["frame", "gt_id"]).where("team is not null")
    votes = teams.groupBy("pred_id", "team").agg(F.count("*").alias("n"), F.min(F.struct("frame", "gt_id")).alias("seen"))
    top = votes.groupBy("pred_id").agg(F.max_by("team", F.struct("n", -F.col("seen.frame"), -F.col("seen.gt_id"))).alias("truth"))
    declared = pred.groupBy(F.col("obj_id").alias("pred_id")).agg(F.min_by("team", "frame").alias("declared"))
    return top.join(declared, "pred_id").select("pred_id", "declared", "truth", (F.col("declared") == F.col("truth")).alias("right"))


def collective_coverage(gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of truths of a team matched by a row of the same team, the better of the two ways to name the teams."""
    t = gt.select("frame", F.col("obj_id").alias("gt_id"), fn.team_group(F.col("team")).alias("truth")).where("truth is not null")
    p = pred.select("frame", F.col("obj_id").alias("pred_id"), fn.team_group(F.col("team")).alias("team"))
    m = t.join(pairs.join(p, ["frame", "pred_id"]), ["frame", "gt_id"], "left")
    hits = lambda c: F.count(F.when(c == F.col("truth"), 1))
    by = m.groupBy("truth").agg(F.count("*").alias("n"), hits(F.col("team")).alias("direct"), hits(_swap(F.col("team"))).alias("swapped"))
    total = by.agg(F.sum("direct").alias("d"), F.sum("swapped").alias("s"))
    best = F.when(F.col("s") > F.col("d"), F.col("swapped")).otherwise(F.col("direct"))
    return by.crossJoin(F.broadcast(total)).select("truth", "n", best.alias("hits"), fn.rounded(best / F.col("n")).alias("coverage"), (F.col("s") > F.col("d")).alias("swapped"))


def team_summary(gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Confusion of labels on matched rows; A and B are exchanged if that agrees more, keepers never."""
    t = gt.select("frame", F.col("obj_id").alias("gt_id"), F.col("team").alias("truth"))
    p = pred.select("frame", F.col("obj_id").alias("pred_id"), "team")
    m = pairs.join(t, ["frame", "gt_id"]).join(p, ["frame", "pred_id"]).where("truth is not null")
    total = m.agg(F.count(F.when(F.col("team") == F.col("truth"), 1)).alias("d"), F.count(F.when(_swap(F.col("team")) == F.col("truth"), 1)).alias("s"))
    named = m.crossJoin(F.broadcast(total)).withColumn("said", F.when(F.col("s") > F.col("d"), _swap(F.col("team"))).otherwise(F.col("team")))
    return named.groupBy("truth", "said").agg(F.count("*").alias("n"))


def concurrency(gt: DataFrame, pred: DataFrame, frames: DataFrame) -> DataFrame:
    """Identities with a row at each frame: median, 90 % point and most, and how many too many in the median."""
    n = lambda df, name: df.groupBy("frame").agg(F.count("*").alias(name))
    s = frames.select("frame").distinct().join(n(pred, "p"), "frame", "left").join(n(gt, "g"), "frame", "left").na.fill(0)
    pct = lambda c, q: F.expr(f"percentile({c}, {q})")
    return s.agg(F.median("p").alias("pred_median"), fn.rounded(pct("p", 0.9)).alias("pred_p90"), F.max("p").alias("pred_max"), F.median("g").alias("gt_median"), fn.rounded(pct("g", 0.9)).alias("gt_p90"), (F.median("p") - F.median("g")).alias("excess"))


def impossible_runs(rows: DataFrame, v_max: float = 8.5, least_s: float = 0.5) -> DataFrame:
    """Runs of steps too fast for a person: how many, of how many identities, and how long in all."""
    r = islands.fast_runs(rows, v_max, least_s)
    top = islands.speeds(rows).agg(fn.rounded(F.max("speed")).alias("top_speed"))
    return r.agg(F.count("*").alias("runs"), F.countDistinct("id_jugador").alias("ids"), fn.rounded(F.coalesce(F.sum(F.col("end_t") - F.col("start_t")), F.lit(0.0))).alias("seconds")).crossJoin(F.broadcast(top))


FIXES = ("position", "missing", "phantom", "team", "duplicate")


def error_ladder(each: DataFrame) -> DataFrame:
    """Mean error for each of the 32 sets of corrected kinds. ``each``: a row with one error amount for each kind; an amount counts where its kind is not corrected."""
    spark = each.sparkSession
    subsets = spark.createDataFrame([(m, *(bool(m >> i & 1) for i in range(5))) for m in range(32)], "subset int, " + ", ".join(f"fix_{k} boolean" for k in FIXES))
    left = sum((F.when(F.col(f"fix_{k}"), 0.0).otherwise(F.col(k)) for k in FIXES), F.lit(0.0))
    return each.crossJoin(F.broadcast(subsets)).groupBy("subset").agg(F.avg(left).alias("error"), F.count("*").alias("n"))


def shapley(ladder: DataFrame) -> DataFrame:
    """What correcting each kind takes off the error, averaged over all orders of correction."""
    n = len(FIXES)
    parts = []
    for i, kind in enumerate(FIXES):
        rest = [j for j in range(n) if j != i]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for chosen in itertools.combinations(rest, size):
                m = sum(1 << j for j in chosen)
                parts += [(kind, m, weight), (kind, m | 1 << i, -weight)]
    weights = ladder.sparkSession.createDataFrame(parts, "kind string, subset int, weight double")
    return ladder.join(F.broadcast(weights), "subset").groupBy("kind").agg(fn.rounded(F.sum(F.col("error") * F.col("weight"))).alias("share"))


def count_identity(gt: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of a frame = truths - missed + unmatched rows; ``off`` must be 0."""
    n = lambda df, name: df.groupBy("frame").agg(F.count("*").alias(name))
    s = shared_frames(gt, rows).join(n(gt, "truths"), "frame").join(n(rows, "rows"), "frame").join(n(pairs, "matched"), "frame", "left").na.fill(0)
    return s.agg(F.sum("truths").alias("truths"), F.sum("rows").alias("rows"), F.sum(F.col("truths") - F.col("matched")).alias("missed"), F.sum(F.col("rows") - F.col("matched")).alias("extra"), F.sum(F.col("rows") - (F.col("truths") - (F.col("truths") - F.col("matched")) + (F.col("rows") - F.col("matched")))).alias("off"))


def localisation(pairs: DataFrame, gt: DataFrame, edges: tuple[float, ...] = (0, 16, 32, 48, 64)) -> DataFrame:
    """Distance of matched pairs by band of depth (right-closed), and how many truths have none."""
    y = F.col("y_m")
    band = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        band = F.when((y > edges[i]) & (y <= edges[i + 1]), i).otherwise(band)
    m = gt.select("frame", F.col("obj_id").alias("gt_id"), band.alias("band")).join(pairs, ["frame", "gt_id"], "left")
    return m.groupBy("band").agg(F.count("*").alias("n"), F.count("distance").alias("matched"), fn.rounded(F.avg("distance")).alias("mean_m"), fn.rounded(F.median("distance")).alias("median_m"), fn.rounded(F.expr("percentile(distance, 0.9)")).alias("p90_m"))


def team_crossings(pairs: DataFrame, gt: DataFrame) -> DataFrame:
    """Predicted ids by whom they mix: people of both teams, several of one, or one person."""
    t = pairs.join(gt.select("frame", F.col("obj_id").alias("gt_id"), fn.team_group(F.col("team")).alias("team")), ["frame", "gt_id"])
    by = t.groupBy("pred_id").agg(F.countDistinct("gt_id").alias("people"), F.countDistinct("team").alias("teams"))
    return by.groupBy(F.when(F.col("teams") > 1, "cross").when(F.col("people") > 1, "same").otherwise("pure").alias("kind")).agg(F.count("*").alias("ids"))


def purity(pairs: DataFrame) -> DataFrame:
    """For each predicted id: share of its main person, and changes of person from one matched frame to the next."""
    counts = pairs.groupBy("pred_id", "gt_id").agg(F.count("*").alias("n"))
    share = counts.groupBy("pred_id").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    w = W.partitionBy("pred_id").orderBy("frame")
    changes = pairs.withColumn("before", F.lag("gt_id").over(w)).groupBy("pred_id").agg(F.count(F.when(F.col("before") != F.col("gt_id"), 1)).alias("changes"))
    return share.join(changes, "pred_id").select("pred_id", "n", fn.rounded(F.col("top") / F.col("n")).alias("purity"), "changes")


def first_lost(stages: list[tuple[str, DataFrame]], people: DataFrame) -> DataFrame:
    """For each (frame, obj_id) the first stage that no longer has it; null if all do."""
    out = people.select("frame", "obj_id")
    for i, (_, df) in enumerate(stages):
        out = out.join(df.select("frame", "obj_id").distinct().withColumn(f"s{i}", F.lit(True)), ["frame", "obj_id"], "left")
    lost = F.coalesce(*(F.when(F.col(f"s{i}").isNull(), F.lit(name)) for i, (name, _) in enumerate(stages)), F.lit(None).cast("string"))
    return out.select("frame", "obj_id", lost.alias("lost_at"))


def classify_rows(rows: DataFrame, gt: DataFrame, pairs: DataFrame, near_m: float = 2.0, displaced_m: float = 5.0) -> DataFrame:
    """Rows without a truth: staff or referee, else duplicate, else phantom or displaced, the first that holds."""
    left = rows.join(pairs.select("frame", F.col("pred_id").alias("obj_id")), ["frame", "obj_id"], "left_anti")
    g = gt.select(F.col("frame").alias("g_frame"), F.col("obj_id").alias("gt_id"), F.col("x_m").alias("gx"), F.col("y_m").alias("gy"), F.col("label").alias("g_label")).join(pairs.select(F.col("frame").alias("g_frame"), "gt_id", F.lit(True).alias("has")), ["g_frame", "gt_id"], "left")
    away = F.sqrt((F.col("x_m") - F.col("gx")) ** 2 + (F.col("y_m") - F.col("gy")) ** 2)
    inf = F.lit(float("inf"))
    near = lambda c: F.coalesce(F.min(F.when(c, away)), inf)
    m = left.join(g, F.col("frame") == F.col("g_frame"), "left").groupBy("frame", "obj_id", "team").agg(near(F.col("g_label") == "referee").alias("ref"), near(F.col("has")).alias("dup"), near(F.col("has").isNull()).alias("free"))
    kind = F.when((F.col("team") == "staff") | (F.col("ref") <= near_m), "staff").when(F.col("dup") <= near_m, "duplicate").when(F.col("free") <= displaced_m, "displaced").otherwise("phantom")
    return m.select("frame", "obj_id", kind.alias("kind"))


def proximity(gt: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each truth with its nearest other truth and whether it was found."""
    o = gt.select(F.col("frame").alias("o_frame"), F.col("obj_id").alias("o_id"), F.col("x_m").alias("o_x"), F.col("y_m").alias("o_y"))
    away = F.sqrt((F.col("x_m") - F.col("o_x")) ** 2 + (F.col("y_m") - F.col("o_y")) ** 2)
    near = gt.join(o, (F.col("frame") == F.col("o_frame")) & (F.col("obj_id") != F.col("o_id")), "left").groupBy("frame", "obj_id").agg(F.min(away).alias("neighbour_m"))
    return near.join(pairs.select("frame", F.col("gt_id").alias("obj_id"), F.lit(1).alias("f")), ["frame", "obj_id"], "left").select("frame", "obj_id", fn.rounded(F.col("neighbour_m")).alias("neighbour_m"), F.coalesce("f", F.lit(0)).alias("found"))


#: Sums of overlaps are counted in this many parts of one, so they do not depend on the order of their parts.
_PARTS = 1 << 36


def _frames(rows: pd.DataFrame, box_m: float):
    """Of rows by ``frame, obj_id`` with their ``side``: the truths' and the predictions' ids of each frame, and how square boxes of ``box_m`` metres overlap."""
    rows = rows.sort_values(["frame", "obj_id"], kind="stable")
    side, frame, obj, x, y = (rows[c].to_numpy() for c in ("side", "frame", "obj_id", "x_m", "y_m"))
    g, p = side == 0, side == 1
    gf, gi, gx, gy, pf, pi, px, py = (c[k] for k in (g, p) for c in (frame, obj, x, y))
    for f in np.unique(frame):
        a, b = (slice(np.searchsorted(c, f), np.searchsorted(c, f, "right")) for c in (gf, pf))
        w = np.clip(box_m - np.abs(gx[a, None] - px[None, b]), 0, None)
        h = np.clip(box_m - np.abs(gy[a, None] - py[None, b]), 0, None)
        yield gi[a], pi[b], w * h / (2 * box_m**2 - w * h)


def _sides(gt: DataFrame, pred: DataFrame, own: list[str]) -> DataFrame:
    cols = [*own, "frame", "obj_id", "x_m", "y_m"]
    return gt.select(*cols, F.lit(0).alias("side")).unionByName(pred.select(*cols, F.lit(1).alias("side")))


def hota(gt: DataFrame, pred: DataFrame, thresholds: tuple[float, ...] = tuple(i / 20 for i in range(1, 20)), box_m: float = 2.0, key: str | None = None) -> DataFrame:
    """Higher-order accuracy and its detection and association parts, on square boxes of ``box_m`` metres, by threshold of overlap.

    Ranges of ``matching.FRAMES`` frame numbers are read twice: what they say on how
    well two identities agree is summed over the match, and with these sums each
    frame is matched once, whatever the threshold.
    """
    own = [key] if key else []
    # joins take the match by a text, which a null has too
    match = F.to_json(F.struct(*own)) if own else F.lit("")
    both = _sides(gt, pred, own).where("frame is not null").withColumns({"_m": match, "_range": F.floor(F.col("frame") / FRAMES)})
    g_kind, p_kind = (df.schema["obj_id"].dataType.simpleString() for df in (gt, pred))

    def agreements(k: tuple, d: pd.DataFrame) -> pd.DataFrame:
        g_ids, p_ids = (np.unique(d.loc[d["side"] == i, "obj_id"]) for i in (0, 1))
        sums = np.zeros((len(g_ids), len(p_ids)))
        for a, b, s in _frames(d, box_m):
            norm = s.sum(0)[None] + s.sum(1)[:, None] - s
            sums[np.ix_(np.searchsorted(g_ids, a), np.searchsorted(p_ids, b))] += np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
        r, c = np.nonzero(sums)
        return pd.DataFrame({"_m": k[0], "_range": k[1], "gt_id": g_ids[r], "pred_id": p_ids[c], "sum": np.round(sums[r, c] * _PARTS).astype("i8")})

    def matched(k: tuple, d: pd.DataFrame, agreed: pd.DataFrame) -> pd.DataFrame:
        g_ids, p_ids = (np.unique(d.loc[d["side"] == i, "obj_id"]) for i in (0, 1))
        alignment, n = np.zeros((len(g_ids), len(p_ids))), np.zeros((len(thresholds), len(g_ids), len(p_ids)), "i8")
        alignment[np.searchsorted(g_ids, agreed["gt_id"]), np.searchsorted(p_ids, agreed["pred_id"])] = agreed["alignment"]
        for a, b, s in _frames(d, box_m):
            a, b = np.searchsorted(g_ids, a), np.searchsorted(p_ids, b)
            r, c = most_gain(alignment[np.ix_(a, b)] * s)
            for i, t in enumerate(thresholds):
                ok = s[r, c] >= t - 1e-12
                n[i, a[r[ok]], b[c[ok]]] += 1
        i, r, c = np.nonzero(n)
        return pd.DataFrame({"_m": k[0], "i": i.astype("i4"), "gt_id": g_ids[r], "pred_id": p_ids[c], "n": n[i, r, c]})

    ids = f"gt_id {g_kind}, pred_id {p_kind}"
    parts = saved(both.groupBy("_m", "_range").applyInPandas(agreements, f"_m string, _range long, {ids}, sum long"))
    n = both.groupBy("_m", "side", "obj_id").agg(F.countDistinct("frame").alias("n"))
    n_g = n.where("side = 0").select("_m", F.col("obj_id").cast(g_kind).alias("gt_id"), F.col("n").alias("n_g"))
    n_p = n.where("side = 1").select("_m", F.col("obj_id").cast(p_kind).alias("pred_id"), F.col("n").alias("n_p"))
    sums = parts.groupBy("_m", "gt_id", "pred_id").agg((F.sum("sum") / _PARTS).alias("sum")).join(n_g, ["_m", "gt_id"]).join(n_p, ["_m", "pred_id"])
    aligned = sums.select("_m", "gt_id", "pred_id", (F.col("sum") / F.greatest(F.col("n_g") + F.col("n_p") - F.col("sum"), F.lit(1e-9))).alias("alignment"))
    near = parts.select("_m", "_range", "gt_id", "pred_id").join(aligned, ["_m", "gt_id", "pred_id"])
    found = both.groupBy("_m", "_range").cogroup(near.groupBy("_m", "_range")).applyInPandas(matched, f"_m string, i int, {ids}, n long")
    pairs = found.groupBy("_m", "i", "gt_id", "pred_id").agg(F.sum("n").alias("n")).join(n_g, ["_m", "gt_id"]).join(n_p, ["_m", "pred_id"])
    by = pairs.groupBy("_m", "i").agg(F.sum("n").alias("tp"), F.sum(F.round(F.col("n") * F.col("n") / F.greatest(F.col("n_g") + F.col("n_p") - F.col("n"), F.lit(1)) * _PARTS).cast("long")).alias("ass"))
    every = both.groupBy("_m", *own).agg(F.countDistinct(F.when(F.col("side") == 0, F.struct("frame", "obj_id"))).alias("n_g"), F.countDistinct(F.when(F.col("side") == 1, F.struct("frame", "obj_id"))).alias("n_p"))
    every = every.select("*", F.posexplode(F.array(*map(F.lit, map(float, thresholds)))).alias("i", "threshold"))
    tp = F.coalesce("tp", F.lit(0))
    det = tp / F.greatest(F.col("n_g") + F.col("n_p") - tp, F.lit(1))
    ass = F.coalesce(F.col("ass") / _PARTS, F.lit(0.0)) / F.greatest(tp, F.lit(1))
    return every.join(by, ["_m", "i"], "left").select("threshold", F.sqrt(det * ass).alias("hota"), det.alias("det_a"), ass.alias("ass_a"), *own)


def clear_mot(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, box_m: float = 2.0, key: list[str] | None = None, piece: int = 5 * FRAMES, warm: int = FRAMES) -> DataFrame:
    """MOTA and its parts on square boxes of ``box_m`` metres, for each match of ``key``.

    A frame's pairs overlap by ``threshold`` at least; pairs of the frame before come
    first, then most overlap. A switch is a truth matched to another id than the last one.
    A match is read in pieces of ``piece`` frame numbers that hand the last frame's
    pairs on (see ``handover``); ids are numbers.
    """
    own = key or []
    both = _sides(gt, pred, own)
    order = ["frame", "side", "obj_id"]

    def read(state: np.ndarray | None, d: pd.DataFrame) -> tuple[dict, np.ndarray]:
        """For each truth its pairs, switches, overlap, first and last match; and the last frame's pairs."""
        before = {} if state is None else dict(np.reshape(state, (-1, 2)).tolist())
        each: dict[float, list] = {}
        for g_ids, p_ids, iou in _frames(d, box_m):
            kept = np.array([before.get(a) for a in g_ids.tolist()], float)[:, None] == p_ids[None]
            r, c = most_gain(np.where(iou >= threshold - 1e-12, iou + 1000.0 * kept, 0.0))
            before = dict(zip(g_ids[r].tolist(), p_ids[c].tolist(), strict=True))
            for (a, b), o in zip(before.items(), iou[r, c].tolist(), strict=True):
                tp, switches, overlap, first, last = each.get(a, (0, 0, 0, b, b))
                each[a] = (tp + 1, switches + (last != b), overlap + round(o * _PARTS), first, b)
        return each, np.array(sorted(before.items()), float).ravel()

    def told(k: tuple, d: pd.DataFrame, s: pd.Series) -> pd.DataFrame:
        each, _ = read(np.asarray(s["start"], float), d)
        return pd.DataFrame([(*k, a, *found) for a, found in each.items()], columns=[*own, "_n", "gt_id", *counts, "first", "last"])

    counts = ("tp", "switches", "overlap")
    parts = handover.pieces(both, piece, warm, own, "frame")
    states = handover.settled(parts, lambda s, d: read(s, d)[1], order, own)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in parts.select(*own, "_n").schema) + "gt_id double, tp long, switches long, overlap long, first double, last double"
    earlier = F.lag("last").over(W.partitionBy(*own, "gt_id").orderBy("_n"))
    found = handover.from_start(parts, states, told, schema, order, own).withColumn("switches", F.col("switches") + F.coalesce(earlier != F.col("first"), F.lit(False)).cast("long"))
    zero = F.lit(0).cast("long")
    rows = both.select(*own, *(zero.alias(c) for c in counts), *((F.col("side") == i).cast("long").alias(n) for i, n in enumerate(("n_gt", "n_pred"))))
    every = found.select(*own, *counts, zero.alias("n_gt"), zero.alias("n_pred")).unionByName(rows)
    total = every.groupBy(*own).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in (*counts, "n_gt", "n_pred"))).where("n_gt + n_pred > 0")
    tp, fp = F.col("tp"), F.col("n_pred") - F.col("tp")
    return total.select(*own, "tp", (F.col("n_gt") - tp).alias("fn"), fp.alias("fp"), "switches", ((tp - fp - F.col("switches")) / F.greatest("n_gt", F.lit(1))).alias("mota"), (F.col("overlap") / _PARTS / F.greatest(tp, F.lit(1))).alias("motp"))
