"""Teams, keepers, referees and staff."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from . import islands, paths


def vector_means(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector of each group, by components."""
    each = rows.select(*by, F.posexplode(vector).alias("k", "v")).groupBy(*by, "k").agg(F.avg("v").alias("v"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias(vector))


@dataclass(frozen=True)
class Prototypes:
    """Mean colours of the two teams and, if there is a third group, of the others."""

    a: list[float]
    b: list[float]
    other: list[float] | None = None


def fit_prototypes(features: DataFrame, vector: str = "feat", k: int = 8, seed: int = 0) -> Prototypes:
    """Clusters joined by average linkage at the threshold that balances and separates the two largest groups best.

    Clustering runs on all rows (``pyspark.ml``); only the k centres and their
    sizes come to the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = features.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=50, initSteps=5).fit(data)
    centres = np.array(model.clusterCenters())
    sizes = np.zeros(k)
    for r in model.transform(data).groupBy("prediction").count().collect():
        sizes[r["prediction"]] = r["count"]
    away = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    best = None
    for t in np.arange(0.5, 1.3001, 0.05):
        groups = [[i] for i in range(k) if sizes[i]]
        while len(groups) > 1:
            d, i, j = min((away[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
            if d > t:
                break
            groups[i] += groups.pop(j)
        if len(groups) < 2:
            continue
        groups.sort(key=lambda g: (-sizes[g].sum(), g))
        n = [sizes[g].sum() for g in groups]
        mean = [np.average(centres[g], axis=0, weights=sizes[g]) for g in groups]
        score = min(n[:2]) / max(n[:2]) * np.linalg.norm(mean[0] - mean[1])
        if best is None or score > best[0] + 1e-12:
            rest = [c for g in groups[2:] for c in g]
            best = (score, mean[0], mean[1], np.average(centres[rest], axis=0, weights=sizes[rest]) if rest else None)
    if best is None:
        order = np.argsort(-sizes)
        best = (0.0, centres[order[0]], centres[order[min(1, k - 1)]], None)
    return Prototypes(best[1].tolist(), best[2].tolist(), None if best[3] is None else best[3].tolist())


def _away(v: Column, p: list[float]) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(v, F.array(*map(F.lit, p)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def predict(features: DataFrame, p: Prototypes, vector: str = "feat", most: float | None = 1.0, teams_only: bool = False) -> DataFrame:
    """The nearest prototype: A, B or other; further than ``most`` times the teams' distance is other, unless only teams are asked for."""
    v = F.col(vector).cast("array<double>")
    names = [("A", p.a), ("B", p.b)] + ([] if teams_only or p.other is None else [("otro", p.other)])
    d = F.array_sort(F.array(*(F.struct(_away(v, c).alias("d"), F.lit(i).alias("i")) for i, (_, c) in enumerate(names))))
    scored = features.withColumn("_best", F.get(d, F.lit(0)))
    label = F.get(F.array(*(F.lit(n) for n, _ in names)), F.col("_best.i"))
    if most is not None and not teams_only:
        apart = float(np.linalg.norm(np.array(p.a) - np.array(p.b)))
        label = F.when(F.col("_best.d") > most * apart, "otro").otherwise(label)
    return scored.withColumns({"team": label, "away": F.col("_best.d")}).drop("_best")


def identity_colours(rows: DataFrame, by: str = "id_jugador", vector: str = "feat") -> DataFrame:
    """Mean colour of an identity: of its near and unoccluded crops, else of near ones, else of unoccluded ones, else of all.

    ``rows`` has booleans ``near`` and ``free``.
    """
    rank = F.when(F.col("near") & F.col("free"), 0).when(F.col("near"), 1).when(F.col("free"), 2).otherwise(3)
    best = rows.withColumn("_rank", rank)
    top = best.groupBy(by).agg(F.min("_rank").alias("_top"), F.count("*").alias("crops"))
    # "near" alone takes near crops occluded or not, "free" alone those of any distance
    use = (F.col("_top") == 0) & (F.col("_rank") == 0) | (F.col("_top") == 1) & F.col("near") | (F.col("_top") == 2) & F.col("free") | (F.col("_top") == 3)
    chosen = best.join(top, by).where(use)
    return vector_means(chosen, [by, "crops"], vector)


def classify_identities(rows: DataFrame, p: Prototypes, by: str = "id_jugador", least_crops: int = 25) -> DataFrame:
    """A label for each identity; an "other" with few crops is forced to the nearer team."""
    colours = identity_colours(rows, by)
    free, forced = predict(colours, p), predict(colours, p, teams_only=True).select(F.col(by).alias("f"), F.col("team").alias("forced"))
    joined = free.join(forced, F.col(by) == F.col("f"))
    return joined.select(by, "crops", F.when((F.col("team") == "otro") & (F.col("crops") < least_crops), F.col("forced")).otherwise(F.col("team")).alias("team"))


def label_observations(rows: DataFrame, p: Prototypes, half_frames: int = 19, by: str = "id_jugador", vector: str = "feat") -> DataFrame:
    """A label for each row from the mean colour of its identity within a window of frames."""
    w = W.partitionBy(by, "k").orderBy("frame").rangeBetween(-half_frames, half_frames)
    each = rows.select(by, "frame", F.posexplode(vector).alias("k", "v")).withColumn("m", F.avg("v").over(w))
    mean = each.groupBy(by, "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias(vector))
    return predict(mean, p).select(by, "frame", "team")


@dataclass(frozen=True)
class Kit:
    """A referee's kit: ranges of hue and saturation."""

    name: str
    hue: tuple[float, float]
    saturation: tuple[float, float]


def matching_kits(features: DataFrame, kits: list[Kit], prototypes: list[list[float]], vector: str = "feat") -> DataFrame:
    """Rows with the first kit whose ranges hold their colour; a kit that holds a team's own colour is off."""
    def holds(kit: Kit, hs: tuple[float, float]) -> bool:
        return kit.hue[0] <= hs[0] < kit.hue[1] and kit.saturation[0] <= hs[1] < kit.saturation[1]

    def colour(v: list[float]) -> tuple[float, float]:
        i = int(np.argmax(v[:256]))
        return (i // 16 + 0.5) * 180 / 16, (i % 16 + 0.5) * 256 / 16

    use = [k for k in kits if not any(holds(k, colour(p)) for p in prototypes)]
    hue, sat = fn.hue_saturation(F.col(vector).cast("array<double>"))
    label = F.lit(None).cast("string")
    for k in reversed(use):
        label = F.when((hue >= k.hue[0]) & (hue < k.hue[1]) & (sat >= k.saturation[0]) & (sat < k.saturation[1]), k.name).otherwise(label)
    return features.withColumn("kit", label)


def keepers_by_area(rows: DataFrame, length: float = 100.0, width: float = 64.0, depth: float = 16.5, half: float = 20.16, margin: float = 1.0, label_free: bool = True) -> DataFrame:
    """One keeper a side: the identity whose median lies in the penalty area and that has most rows there (of equals the larger id)."""
    med = rows.groupBy("id_jugador").agg(F.median("x_m").alias("mx"), F.median("y_m").alias("my"))
    in_y = lambda y: F.abs(y - width / 2) <= half + margin
    side = lambda x: F.when(x <= depth + margin, 0).when(x >= length - depth - margin, 1)
    lives = med.where(in_y(F.col("my"))).select("id_jugador", side(F.col("mx")).alias("side")).where("side is not null")
    inside = rows.where(in_y(F.col("y_m"))).select("id_jugador", side(F.col("x_m")).alias("row_side"))
    n = lives.join(inside, "id_jugador").where("side = row_side").groupBy("id_jugador", "side").agg(F.count("*").alias("n"))
    w = W.partitionBy("side").orderBy(F.desc("n"), F.desc("id_jugador"))
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("side", "id_jugador", "n")


def defended_sides(rows: DataFrame, length: float = 100.0, width: float = 64.0, undecided: float = 0.02) -> DataFrame:
    """Mean x of each team on the pitch, and which side it defends; none if the teams stand too close together."""
    on = rows.where(F.col("equipo").isin(0, 1) & F.col("x_m").between(0, length) & F.col("y_m").between(0, width) & ~F.col("etiqueta").startswith("portero_"))
    m = on.agg(F.avg(F.when(F.col("equipo") == 0, F.col("x_m"))).alias("a"), F.avg(F.when(F.col("equipo") == 1, F.col("x_m"))).alias("b"))
    return m.select(fn.rounded(F.col("a")).alias("a_x"), fn.rounded(F.col("b")).alias("b_x"), F.when(F.abs(F.col("a") - F.col("b")) < undecided * length, None).when(F.col("a") < F.col("b"), "A left").otherwise("B left").alias("sides"))


def last_men(rows: DataFrame, length: float = 100.0) -> DataFrame:
    """Identities by how often they are the last man of a side: hits, frames seen, and the lower bound of the share."""
    team = rows.where(F.col("equipo").isin(0, 1))
    ends = team.groupBy("frame").agg(F.min_by("id_jugador", F.struct("x_m", "id_jugador")).alias("left"), F.max_by("id_jugador", F.struct("x_m", "id_jugador")).alias("right"))
    hits = ends.select("frame", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("id")), F.struct(F.lit(1).alias("side"), F.col("right").alias("id")))).alias("e")).groupBy("e.side", F.col("e.id").alias("id_jugador")).agg(F.count("*").alias("hits"))
    seen = team.groupBy("id_jugador").agg(F.count("*").alias("seen"))
    return hits.join(seen, "id_jugador").select("side", "id_jugador", "hits", "seen", fn.rounded(fn.wilson_lower(F.col("hits"), F.col("seen"))).alias("score"))


def keeper_set(scores: DataFrame, rows: DataFrame, least_score: float = 0.3, least_new: float = 0.5, most_together_m: float = 2.0, least_presence: float = 0.5, key: list[str] | None = None) -> DataFrame:
    """Identities that together are a side's keeper: those seen most come first, each must bring mostly new frames.

    A frame is new if no chosen identity stands within ``most_together_m`` in it. A side
    whose chosen identities cover less than ``least_presence`` of the frames has no
    keeper. Candidates of a side of a match are one group.
    """
    own = key or []
    total = rows.where(F.col("equipo").isin(0, 1)).groupBy(*own).agg(F.countDistinct("frame").alias("n_frames"))
    each = rows.select(*own, "id_jugador", "frame", "x_m", "y_m").join(scores.where(F.col("score") >= least_score).select(*own, "side", "id_jugador"), [*own, "id_jugador"])
    each = each.join(F.broadcast(total), own) if own else each.crossJoin(F.broadcast(total))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        places: dict[int, list[tuple[float, float]]] = {}
        chosen = []
        sizes = g.groupby("id_jugador")["frame"].nunique()
        for i in sorted(sizes.index, key=lambda i: (-sizes[i], i)):
            mine = g[g["id_jugador"] == i].drop_duplicates("frame")
            new = sum(all(np.hypot(x - qx, y - qy) > most_together_m for qx, qy in places.get(f, ())) for f, x, y in mine[["frame", "x_m", "y_m"]].itertuples(index=False))
            if new >= least_new * len(mine):
                chosen.append(i)
                for f, x, y in mine[["frame", "x_m", "y_m"]].itertuples(index=False):
                    places.setdefault(f, []).append((x, y))
        if len(places) < least_presence * g["n_frames"].iloc[0]:
            chosen = []
        out = pd.DataFrame({c: [g[c].iloc[0]] * len(chosen) for c in (*own, "side")} | {"id_jugador": chosen})
        return out.astype({"side": "int32", "id_jugador": "int32"})

    from pyspark.sql import types as T

    schema = T.StructType([*(rows.schema[c] for c in own), T.StructField("side", T.IntegerType()), T.StructField("id_jugador", T.IntegerType())])
    return each.groupBy(*own, "side").applyInPandas(run, schema)


def staff(rows: DataFrame, length: float = 100.0, width: float = 64.0, out_m: float = 2.0, far_m: float = 6.0, least: int = 5, slow: float = 0.6, slow_least: int = 25) -> DataFrame:
    """Identities that are staff: mostly outside (with enough rows, or very far), or slow beside the line and no keeper."""
    outside = rows.groupBy("id_jugador").agg(F.median(fn.outside_distance(F.col("x_m"), F.col("y_m"), length, width)).alias("out"), F.median(fn.edge_distance(F.col("x_m"), F.col("y_m"), length, width)).alias("edge"), F.count("*").alias("n"), F.max(F.col("etiqueta").startswith("portero_")).alias("keeper"))
    pace = islands.speeds(rows).groupBy("id_jugador").agg((F.sum("step_m") / F.sum("dt")).alias("pace"))
    s = outside.join(pace, "id_jugador", "left")
    far = (F.col("out") > out_m) & ((F.col("n") >= least) | (F.col("out") > far_m))
    idle = (F.col("edge") > -out_m) & (F.col("pace") < slow) & (F.col("n") >= slow_least) & ~F.col("keeper")
    return s.where(far | F.coalesce(idle, F.lit(False))).select("id_jugador", fn.rounded(F.col("out")).alias("out_m"), "n")


def one_referee(rows: DataFrame, least: int = 25, length: float = 100.0, width: float = 64.0, key: list[str] | None = None) -> DataFrame:
    """The identity of neither team with most rows on the pitch, in each match of ``key``."""
    n = rows.where((F.col("equipo") == 2) & F.col("x_m").between(0, length) & F.col("y_m").between(0, width)).groupBy(*(key or []), "id_jugador").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("r", F.row_number().over(W.partitionBy(*(key or [])).orderBy(F.desc("n"), "id_jugador"))).where("r = 1").select(*(key or []), "id_jugador", "n")


def fit_emissions(rows: DataFrame, value: str, is_referee: str, edges: list[float]) -> DataFrame:
    """Log-likelihood ratio of each bin of a colour distance, add-one smoothed."""
    bin_ = fn.clamp(F.size(F.filter(F.array(*map(F.lit, edges[1:])), lambda e: e <= F.col(value))), 0, len(edges) - 2).cast("int")
    n = rows.groupBy(bin_.alias("bin")).agg(F.count(F.when(F.col(is_referee), 1)).alias("yes"), F.count(F.when(~F.col(is_referee), 1)).alias("no"))
    all_bins = rows.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").na.fill(0)
    t = all_bins.agg(F.sum("yes").alias("ty"), F.sum("no").alias("tn"))
    k = len(edges) - 1
    return all_bins.crossJoin(F.broadcast(t)).select("bin", fn.rounded(F.log((F.col("yes") + 1) / (F.col("ty") + k)) - F.log((F.col("no") + 1) / (F.col("tn") + k))).alias("log_lr"))


def referee_path(cands: DataFrame, sigma: float = 1.5, most_s: float = 2.5, hidden: float = 0.0, reacquire: float = 8.0, key: str | None = None, seconds: float | None = None) -> DataFrame:
    """The most likely path of the one referee through candidates (``frame, t, det_idx, mx, my, log_lr``), who may be out of sight.

    A match is one group; with ``seconds`` a group is a segment of that length, and the path is the same (``paths.cheapest``).
    """
    def move(dt: np.ndarray, off: np.ndarray, between: np.ndarray) -> np.ndarray:
        return (off**2).sum(1) / (2 * (sigma**2) * np.maximum(dt, 1e-6) * 4)

    chain = paths.Chain(most_s, move, reacquire, (-hidden, 0.0), ("mx", "my"), own="_cost", folded=True)
    return paths.cheapest(cands.withColumn("_cost", -F.col("log_lr")), chain, "det_idx", seconds, key=[key] if key else None).drop("_cost")


def apply_referee(rows: DataFrame, path: DataFrame) -> DataFrame:
    """Rows on the path become "otro"."""
    on = path.select("frame", F.col("det_idx").alias("_d"), F.lit(True).alias("_ref"))
    return rows.join(on, (rows["frame"] == on["frame"]) & (rows["det_idx"] == F.col("_d")), "left").select(*(rows[c] for c in rows.columns if c != "etiqueta"), F.when(F.col("_ref"), "otro").otherwise(rows["etiqueta"]).alias("etiqueta"))


def capped_labels(votes: DataFrame, cap: int = 7, others: int = 1, key: list[str] | None = None) -> DataFrame:
    """Labels within the numbers that a frame allows, at the least total score of the rows that change. ``votes``: ``frame, id_jugador, team, score``.

    Rows of a team beyond its number are its least sure; of all such rows of a frame
    the least sure fill the places that are left, those of A, then of B, then of
    the others. Where places run out, the surest stay over the number.
    """
    frame = ["frame", *(key or [])]
    order = (F.desc("score"), F.asc("id_jugador"))
    limit = F.when(F.col("team") == "otro", others).otherwise(cap)
    n = {t: F.sum((F.col("team") == t).cast("int")).over(W.partitionBy(*frame)) for t in ("A", "B", "otro")}
    free = {t: F.greatest(F.lit(others if t == "otro" else cap) - c, F.lit(0)) for t, c in n.items()}
    s = votes.withColumns({"_over": F.row_number().over(W.partitionBy(*frame, "team").orderBy(*order)) > limit, **{f"_{t}": c for t, c in free.items()}})
    # least sure first among the rows over their number
    turn = F.row_number().over(W.partitionBy(*frame, "_over").orderBy(F.asc("score"), F.desc("id_jugador")))
    a, b, o = (F.col(f"_{t}") for t in ("A", "B", "otro"))
    moved = F.when(turn <= a, "A").when(turn <= a + b, "B").when(turn <= a + b + o, "otro").otherwise(F.col("team"))
    return s.select(*frame, "id_jugador", F.when(F.col("_over"), moved).otherwise(F.col("team")).alias("team"))
