"""Cutting identities where boxes touch, and linking what comes out to what went in.

Within a crossing neither overlap nor looks tell people apart; before and after it
they do. An identity falls into pieces: each run of clean rows with the crossing
after it. A piece that goes into a crossing is linked to one that comes out of one
by where its velocity would have brought it and, if there are vectors, by the looks
of both sides' clean rows. Pieces that can meet form small groups (the parts of the
graph of possible links), and each group is one assignment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import islands
from .lineage import saved
from .matching import assign
from .tracking import components

#: More pieces than an identity can have.
PIECES = 1_000_000
#: Clean rows that give a piece its velocity, and those that give it its look when it comes out.
LAST, FIRST = 5, 10
#: Possible links whose crossings one call solves, one by one.
TOGETHER = 4000


def pieces(rows: DataFrame, crossed: str = "crossed", key: str = "id_jugador") -> DataFrame:
    """Rows with ``piece``: a number unique over identities. A crossing before the first clean row belongs to the first piece."""
    w = W.partitionBy(key).orderBy("frame")
    begins = ~F.col(crossed) & F.coalesce(F.lag(crossed).over(w), F.lit(True))
    n = F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("piece", F.col(key).cast("bigint") * PIECES + F.greatest(n, F.lit(1)))


def random_cuts(rows: DataFrame, seed: int = 0, crossed: str = "crossed", key: str = "id_jugador") -> DataFrame:
    """Rows whose crossings are single ones at random, as many for each identity as it has crossings: the control that cutting elsewhere does as well."""
    w, whole = W.partitionBy(key).orderBy("frame"), W.partitionBy(key)
    enters = F.coalesce(F.col(crossed) & ~F.lag(crossed).over(w), F.lit(False))
    marked = rows.withColumns({"_cuts": F.sum(enters.cast("int")).over(whole), "_i": F.row_number().over(w), "_n": F.count("*").over(whole)})
    inner = (F.col("_i") > 1) & (F.col("_i") < F.col("_n"))
    turn = F.row_number().over(W.partitionBy(key, inner).orderBy(F.xxhash64(key, "frame", F.lit(seed)), "frame"))
    return marked.withColumn(crossed, inner & (turn <= F.col("_cuts"))).drop("_cuts", "_i", "_n")


def _model(clean: DataFrame, vector: str, share: float, place: Column, n: Column) -> DataFrame:
    """Exponentially averaged vectors of pieces, by their weights: the row at the last ``place`` of ``n`` counts ``share``, the one before that share of the rest, and so on."""
    left = F.pow(F.lit(1 - share), n - place)
    weight = F.when(place == 1, left).otherwise(share * left)
    each = clean.select("piece", weight.alias("_w"), F.posexplode(F.col(vector).cast("array<double>")).alias("k", "v"))
    sums = each.groupBy("piece", "k").agg(F.sum(F.col("_w") * F.col("v")).alias("v"))
    return sums.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("model"))


def ends(cut: DataFrame, v_cap: float = 10.0, share: float = 0.2, vector: str | None = None, crossed: str = "crossed", key: str = "id_jugador", t: str = "tiempo_s", match: list[str] | None = None) -> DataFrame:
    """Pieces with a clean row: times and places of its first and last, the velocity of the last few, whether it goes into and comes out of a crossing, and its looks."""
    by = W.partitionBy("piece")
    clean = cut.where(~F.col(crossed)).withColumns({"_i": F.row_number().over(by.orderBy("frame")), "_n": F.count("*").over(by)})
    late = F.when(F.col("_i") > F.col("_n") - LAST, F.struct(t, "x_m", "y_m"))
    s = clean.groupBy("piece", *(match or [])).agg(F.min(F.struct(t, "x_m", "y_m")).alias("a"), F.max(F.struct(t, "x_m", "y_m")).alias("z"), F.min(late).alias("l"))
    dt = F.col(f"z.{t}") - F.col(f"l.{t}")
    v = {c: F.when(dt > 0, (F.col(f"z.{c}_m") - F.col(f"l.{c}_m")) / F.nullif(dt, F.lit(0.0))).otherwise(0.0) for c in ("x", "y")}
    speed = F.sqrt(v["x"] ** 2 + v["y"] ** 2)
    capped = {c: x * F.when(speed > v_cap, v_cap / speed).otherwise(1.0) for c, x in v.items()}
    last = cut.groupBy("piece").agg(F.max(F.when(F.col(crossed), F.col(t))).alias("_c"))
    out = s.join(last, "piece").select(
        F.col("piece").alias("tracklet_id"), *(match or []), F.col(f"a.{t}").alias("t0"), F.col(f"z.{t}").alias("t1"), F.col("a.x_m").alias("x0"), F.col("a.y_m").alias("y0"), F.col("z.x_m").alias("x1"), F.col("z.y_m").alias("y1"),
        capped["x"].alias("vx"), capped["y"].alias("vy"), F.coalesce(F.col("_c") > F.col(f"z.{t}"), F.lit(False)).alias("enters"), (F.col("piece") % PIECES > 1).alias("leaves"),
    )
    if vector is not None:
        known = clean.where(F.col(vector).isNotNull())
        ranked = known.withColumns({"_k": F.row_number().over(by.orderBy("frame")), "_m": F.count("*").over(by)})
        after = _model(ranked, vector, share, F.col("_k"), F.col("_m")).select(F.col("piece").alias("tracklet_id"), F.col("model").alias("look_out"))
        early = known.where(F.col("_i") <= FIRST).withColumns({"_k": F.row_number().over(by.orderBy(F.desc("frame"))), "_m": F.count("*").over(by)})
        before = _model(early, vector, share, F.col("_k"), F.col("_m")).select(F.col("piece").alias("tracklet_id"), F.col("model").alias("look_in"))
        out = out.join(after, "tracklet_id", "left").join(before, "tracklet_id", "left")
    return out


def links(found: DataFrame, most_s: float = 1.0, most_m: float = 1.5, growth: float = 0.0, look_weight: float = 0.5, most_look: float = 0.973, separation: float | None = None, match: list[str] | None = None) -> DataFrame:
    """``a, b, cost``: at most one piece after each piece that goes in, at least total cost among as many links as there can be."""
    pairs = islands.range_candidates(found, most_s, match).where("a_enters and b_leaves")
    away = F.sqrt((F.col("a_x1") + F.col("a_vx") * F.col("gap") - F.col("b_x0")) ** 2 + (F.col("a_y1") + F.col("a_vy") * F.col("gap") - F.col("b_y0")) ** 2)
    most = most_m + growth * F.col("gap")
    cost, ok = away / most, away <= most
    if separation is not None:
        apart = F.sqrt(F.aggregate(F.zip_with("a_look_out", "b_look_in", lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, d: s + d)) / separation
        ok, cost = ok & F.coalesce(apart <= most_look, F.lit(True)), cost + look_weight * F.coalesce(apart, F.lit(0.0))
    possible = saved(pairs.where(ok).select(F.col("a_tracklet_id").alias("a"), F.col("b_tracklet_id").alias("b"), cost.alias("cost")))
    # a piece has two ends, which are two nodes
    edges = possible.select((F.col("a") * 2).alias("a"), (F.col("b") * 2 + 1).alias("b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("tracklet_id")).distinct()
    named = components(nodes, edges)

    dealt = max(1, -(-possible.count() // TOGETHER))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["identity_id", "a", "b"])
        part, a, b, cost = (g[c].to_numpy() for c in ("identity_id", "a", "b", "cost"))
        edges = np.flatnonzero(np.diff(part, append=part[-1] + 1)) + 1
        out = []
        for i, j in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=True):
            rows, row = np.unique(a[i:j], return_inverse=True)
            columns, column = np.unique(b[i:j], return_inverse=True)
            table = np.full((len(rows), len(columns)), 1e6)
            table[row, column] = cost[i:j]
            r, c = assign(table) if table.size > 1 else (np.zeros(1, int), np.zeros(1, int))
            real = table[r, c] < 1e6
            out.append((rows[r[real]], columns[c[real]], table[r, c][real]))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("a", "b", "cost"), zip(*out, strict=True), strict=True)})

    parts = possible.join(named, F.col("a") * 2 == F.col("tracklet_id")).withColumn("_deal", F.pmod(F.xxhash64("identity_id"), F.lit(dealt)))
    return parts.groupBy("_deal").applyInPandas(run, "a long, b long, cost double")


def relink(rows: DataFrame, v_cap: float = 10.0, most_s: float = 1.0, most_m: float = 1.5, growth: float = 0.0, vector: str | None = None, separation: float | None = None, look_weight: float = 0.5, most_look: float = 0.973, share: float = 0.2, crossed: str = "crossed", key: str = "id_jugador", t: str = "tiempo_s", match: list[str] | None = None) -> DataFrame:
    """Rows with ``piece_id``, the first piece of the chain that they belong to now, and ``kept``.

    A crossing stays with the piece that went in, up to the first clean row of the piece
    that follows in its chain; a chain keeps one row a frame, that of the earlier piece.
    ``match``: columns that keep matches apart; identities are unique over matches.
    """
    cut = saved(pieces(rows, crossed, key))
    found = saved(ends(cut, v_cap, share, vector, crossed, key, t, match))
    chosen = saved(links(found, most_s, most_m, growth, look_weight, most_look, separation if vector is not None else None, match))
    chains = components(cut.select(F.col("piece").alias("tracklet_id")).distinct(), chosen).select(F.col("tracklet_id").alias("piece"), F.col("identity_id").alias("piece_id"))
    until = chosen.join(found.select(F.col("tracklet_id").alias("b"), F.col("t0").alias("_until")), "b").select(F.col("a").alias("piece"), "_until")
    starts = W.partitionBy("piece")
    in_time = F.col("_until").isNull() | (F.col(t) < F.col("_until"))
    named = cut.withColumn("_from", F.min(t).over(W.partitionBy("piece"))).join(until, "piece", "left").join(chains, "piece").withColumn("_in", in_time)
    turn = F.row_number().over(W.partitionBy("piece_id", "frame", "_in").orderBy("_from", "piece"))
    return named.withColumn("kept", F.col("_in") & (turn == 1)).select(*rows.columns, "piece_id", "kept")
