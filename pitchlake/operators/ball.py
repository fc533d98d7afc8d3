"""The ball: candidates, choice, flights, contacts, possession."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from . import islands, paths, tracking
from .lineage import saved
from .matching import FRAMES


def plausible(cands: DataFrame, length: float, width: float, margin: float = 3.0) -> DataFrame:
    """Candidates on the pitch or up to a margin off it."""
    return cands.where(F.col("mx").between(-margin, length + margin) & F.col("my").between(-margin, width + margin))


def mark_cells(cands: DataFrame, cell_px: int = 12, least: int = 100, least_span_s: float = 120.0, most_spread_px: float = 4.0) -> DataFrame:
    """Cells of the image where something stays put: many hits, over a long time, close together."""
    cell = lambda c: F.floor(F.col(c) / cell_px).cast("int")
    by = cands.groupBy(cell("px").alias("cx"), cell("py").alias("cy")).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span_s"), fn.rounded(F.greatest(F.stddev_pop("px"), F.stddev_pop("py"))).alias("spread_px"), F.countDistinct(F.floor(F.col("t") / 60)).alias("minutes"))
    return by.where((F.col("n") >= least) & (F.col("span_s") >= least_span_s) & (F.col("spread_px") <= most_spread_px))


def static_marks(cands: DataFrame, share: float = 0.5, **kw) -> DataFrame:
    """Groups of neighbouring mark cells seen in enough of the minutes: ``cx, cy, mark``.

    A mark on the edge of two cells is seen now in one, now in the other: a group's
    minutes are those of all its cells together. Cells are few (an image has some
    thousands). Neighbours are an equi-join on the shifted keys of half of a cell's
    surroundings, and groups are the components of these links.
    """
    cell_px, minute = kw.get("cell_px", 12), F.floor(F.col("t") / 60)
    minutes = cands.agg(F.countDistinct(minute)).first()[0]
    cells = saved(mark_cells(cands, **kw).withColumn("label", F.col("cx") * 100_000 + F.col("cy")))
    shift = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    near = cells.withColumn("s", shift).select((F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"), F.col("label").alias("a"))
    links = cells.join(near, ["cx", "cy"]).select("a", F.col("label").alias("b"))
    named = tracking.components(cells.select(F.col("label").alias("tracklet_id")), links)
    marked = cells.join(named, F.col("label") == F.col("tracklet_id"))
    cell = lambda c: F.floor(F.col(c) / cell_px).cast("int")
    at = cands.select(cell("px").alias("cx"), cell("py").alias("cy"), minute.alias("minute")).distinct().join(marked.select("cx", "cy", "identity_id"), ["cx", "cy"])
    seen = at.groupBy("identity_id").agg(F.countDistinct("minute").alias("_seen")).where(F.col("_seen") >= share * max(minutes, 1)).select("identity_id")
    return marked.join(seen, "identity_id").select("cx", "cy", F.col("identity_id").alias("mark"))


def without_marks(cands: DataFrame, marks: DataFrame, cell_px: int = 12) -> DataFrame:
    """Candidates outside all mark cells."""
    cell = lambda c: F.floor(F.col(c) / cell_px).cast("int")
    return cands.join(marks.select(F.col("cx").alias("m_cx"), F.col("cy").alias("m_cy")), (cell("px") == F.col("m_cx")) & (cell("py") == F.col("m_cy")), "left_anti")


def nearest_people(cands: DataFrame, people: DataFrame) -> DataFrame:
    """Candidates with the distance to the nearest person of their frame (null: nobody)."""
    p = people.select(F.col("frame").alias("p_frame"), F.col("x_m").alias("p_x"), F.col("y_m").alias("p_y"))
    away = F.sqrt((F.col("mx") - F.col("p_x")) ** 2 + (F.col("my") - F.col("p_y")) ** 2)
    return cands.join(p, F.col("frame") == F.col("p_frame"), "left").groupBy(*cands.columns).agg(F.min(away).alias("player_m"))


def pick_nearest(cands: DataFrame, people: DataFrame) -> DataFrame:
    """One candidate a frame: nearest to a person, then surest, then first."""
    order = W.partitionBy("frame").orderBy(F.asc_nulls_last("player_m"), F.desc("conf"), "cand_idx")
    return nearest_people(cands, people).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def group_objects(cands: DataFrame, reach_m: float = 8.0, reach_frames: int = 30, key: str | None = None) -> DataFrame:
    """Candidates with the number of their object: the first one still open that is near enough. Order matters, so a match is one group."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "cand_idx"])
        # by number, so in the order in which they began; those out of reach in time never come back
        open_: dict[int, tuple[float, float, float]] = {}
        out, n, at = [], 0, None
        for f, x, y in g[["frame", "mx", "my"]].itertuples(index=False):
            if f != at:
                at, open_ = f, {i: o for i, o in open_.items() if f - o[0] <= reach_frames}
            for i, (_, lx, ly) in open_.items():
                if np.hypot(x - lx, y - ly) <= reach_m:
                    break
            else:
                i, n = n, n + 1
            open_[i] = (f, x, y)
            out.append(i)
        return g.assign(object=np.array(out, "int32"))

    from pyspark.sql import types as T

    return cands.groupBy(*([key] if key else [])).applyInPandas(run, T.StructType([*cands.schema.fields, T.StructField("object", T.IntegerType())]))


def without_parked(grouped: DataFrame, people: DataFrame, least: int = 3, most_step_m: float = 0.05, least_player_m: float = 10.0) -> DataFrame:
    """Objects that do not move, far from people, are no ball in play."""
    w = W.partitionBy("object").orderBy("frame", "cand_idx")
    step = F.sqrt((F.col("mx") - F.lag("mx").over(w)) ** 2 + (F.col("my") - F.lag("my").over(w)) ** 2)
    by = nearest_people(grouped, people).withColumn("step", step).groupBy("object").agg(F.count("*").alias("n"), F.median("step").alias("step"), F.median("player_m").alias("away"))
    parked = by.where((F.col("n") >= least) & (F.col("step") < most_step_m) & (F.coalesce("away", F.lit(float("inf"))) > least_player_m))
    return grouped.join(parked, "object", "left_anti")


def best_path(cands: DataFrame, no_ball: float = 1.0, jump: float = 3.0, v_px: float = 1000.0, slack_px: float = 20.0, most_s: float = 0.5, key: str | None = None, seconds: float | None = None) -> DataFrame:
    """At most one candidate a frame so that missing frames and jumps between objects cost least in all.

    Candidates of a frame come preferred first (``cand_idx``); between equally
    cheap paths the one with more preferred candidates wins. The path of a
    match is one sequence, so a match is one group; with ``seconds`` a group is
    a segment of that length, and the path is the same (``paths.cheapest``).
    """
    def move(dt: np.ndarray, off: np.ndarray, between: np.ndarray) -> np.ndarray:
        return np.where(np.hypot(*off.T) <= v_px * dt + slack_px, no_ball * between, np.inf)

    chain = paths.Chain(most_s, move, jump, (no_ball, 1.0), ("px", "py"), tie=lambda rank: float(rank > 0))
    return paths.cheapest(cands, chain, "cand_idx", seconds, key=[key] if key else None)


def continuity_segments(track: DataFrame, v_px: float = 1000.0, slack_px: float = 20.0, most_s: float = 0.5, key: list[str] | None = None) -> DataFrame:
    """The chosen ball with ``segment``, which grows where a step is too long for its time, and ``cut``."""
    w = W.partitionBy(*(key or [])).orderBy("frame")
    dt = F.col("t") - F.lag("t").over(w)
    away = F.sqrt((F.col("px") - F.lag("px").over(w)) ** 2 + (F.col("py") - F.lag("py").over(w)) ** 2)
    cut = F.coalesce((dt > most_s) | (away > v_px * dt + slack_px), F.lit(False))
    return track.withColumn("cut", cut).withColumn("segment", F.sum(F.col("cut").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))


def aerial(track: DataFrame, v_ground: float = 20.0, size_factor: float = 1.6, least_s: float = 0.15, v_sure: float = 40.0, key: list[str] | None = None) -> DataFrame:
    """The chosen ball with ``aerial``: too fast for the ground (both ends of a step), or larger than its distance allows; short runs are cleared, steps beyond all doubt set again."""
    own = key or []
    w = W.partitionBy(*own).orderBy("frame")
    step = lambda d: F.sqrt((F.col("mx") - F.lag("mx").over(w)) ** 2 + (F.col("my") - F.lag("my").over(w)) ** 2) / F.when(d > 0, d)
    s = track.withColumn("_dt", F.col("t") - F.lag("t").over(w)).withColumn("_v", step(F.col("_dt")))
    away = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2)
    k = track.where("h_px > 0").groupBy(*own).agg(F.median(F.col("h_px") * away).alias("_k"), F.count("*").alias("_nk"))
    s = (s.join(F.broadcast(k), own, "left") if own else s.crossJoin(F.broadcast(k))).withColumn("_away", away)
    fast = F.coalesce(F.col("_v") > v_ground, F.lit(False)) | F.coalesce(F.lead("_v").over(w) > v_ground, F.lit(False))
    large = (F.col("_nk") >= 8) & (F.col("h_px") > 0) & (F.col("_away") > 0) & (F.col("h_px") * F.col("_away") / F.col("_k") > size_factor)
    s = s.withColumn("_a", fast | F.coalesce(large, F.lit(False)))
    s = islands.runs(s.withColumn("_one", F.lit(0)), ["_one", *own], "frame", F.col("_a"))
    r = W.partitionBy(*own, "run")
    long = F.max("t").over(r) - F.min("t").over(r) >= least_s
    sure = F.coalesce(F.col("_v") > v_sure, F.lit(False))
    return s.withColumn("aerial", (F.col("_a") & long) | sure).select(*track.columns, "aerial")


def contacts_by_angle(track: DataFrame, people: DataFrame, least_angle: float = 70.0, least_v: float = 4.0, reach_m: float = 3.0, persists: int = 1, key: list[str] | None = None) -> DataFrame:
    """Where the ball turns sharply and keeps to it, with the nearest person within reach (null: nobody). ``track`` may have ``aerial``; such points and their neighbours don't count."""
    w = W.partitionBy(*(key or [])).orderBy("frame")
    v = lambda a, b, c: (F.col(b) - F.col(a)) / c
    s = track if "aerial" in track.columns else track.withColumn("aerial", F.lit(False))
    s = s.withColumns({f"{n}_{c}": F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w) for n, k in (("p", 1), ("n", -1), ("e", -1 - persists)) for c in ("t", "mx", "my", "aerial")})
    d1, d2, d3 = F.col("t") - F.col("p_t"), F.col("n_t") - F.col("t"), F.col("e_t") - F.col("n_t")
    s = s.where((d1 > 0) & (d2 > 0) & ~(F.col("aerial") | F.col("p_aerial") | F.col("n_aerial")))
    s = s.withColumns({"ax": v("p_mx", "mx", d1), "ay": v("p_my", "my", d1), "bx": v("mx", "n_mx", d2), "by": v("my", "n_my", d2), "cx": v("n_mx", "e_mx", F.when(d3 > 0, d3)), "cy": v("n_my", "e_my", F.when(d3 > 0, d3))})
    size = lambda a: F.sqrt(F.col(f"{a}x") ** 2 + F.col(f"{a}y") ** 2)
    cosine = lambda a, b: (F.col(f"{a}x") * F.col(f"{b}x") + F.col(f"{a}y") * F.col(f"{b}y")) / (size(a) * size(b))
    turned = s.where(F.least(size("a"), size("b")) >= least_v).withColumn("angle", fn.degrees(cosine("a", "b"))).where(F.col("angle") >= least_angle)
    held = turned.where(F.col("cx").isNull() | (size("c") == 0) | (fn.degrees(cosine("b", "c")) <= 60.0))
    return owned(held.select(*(key or []), "frame", "t", "mx", "my", "angle"), people, reach_m, key)


def owned(events: DataFrame, people: DataFrame, reach_m: float, key: list[str] | None = None) -> DataFrame:
    """Events with the nearest person of their frame within reach: ``id_jugador, equipo, player_m`` or nulls."""
    p = people.select(*(F.col(c).alias(f"p_{c}") for c in ("frame", *(key or []))), "id_jugador", "equipo", F.col("x_m").alias("p_x"), F.col("y_m").alias("p_y"))
    away = F.sqrt((F.col("mx") - F.col("p_x")) ** 2 + (F.col("my") - F.col("p_y")) ** 2)
    met = away <= reach_m
    for c in ("frame", *(key or [])):
        met = met & (F.col(c) == F.col(f"p_{c}"))
    near = events.join(p, met, "left")
    best = F.min_by(F.struct("id_jugador", "equipo", away.alias("player_m")), F.struct(away, F.col("id_jugador")))
    return near.groupBy(*events.columns).agg(best.alias("b")).select(*events.columns, "b.id_jugador", "b.equipo", "b.player_m")


def acceleration_peaks(track: DataFrame, least: float = 3.0, apart_s: float = 0.2, key: str | None = None) -> DataFrame:
    """Local maxima of the change of velocity, spaced: of two too close the earlier stays."""
    w = W.partitionBy(*([key] if key else [])).orderBy("frame")
    s = track.withColumns({"_dt": F.col("t") - F.lag("t").over(w)})
    s = s.withColumns({"_vx": (F.col("mx") - F.lag("mx").over(w)) / F.col("_dt"), "_vy": (F.col("my") - F.lag("my").over(w)) / F.col("_dt")})
    s = s.withColumn("change", F.sqrt((F.lead("_vx").over(w) - F.col("_vx")) ** 2 + (F.lead("_vy").over(w) - F.col("_vy")) ** 2))
    peak = (F.col("change") >= least) & (F.col("change") >= F.coalesce(F.lag("change").over(w), F.lit(0.0))) & (F.col("change") > F.coalesce(F.lead("change").over(w), F.lit(0.0)))
    peaks = s.where("_dt > 0").withColumn("_peak", peak).where("_peak").select(*([key] if key else []), "frame", "t", "mx", "my", "change")

    def spaced(g: pd.DataFrame) -> pd.DataFrame:
        g, keep, last = g.sort_values("t"), [], -np.inf
        for t in g["t"]:
            keep.append(t - last >= apart_s)
            last = t if keep[-1] else last
        return g[np.array(keep, bool)]

    return peaks.groupBy(*([key] if key else [])).applyInPandas(spaced, peaks.schema)


def merge_contacts(a: DataFrame, b: DataFrame, apart_s: float = 0.2, key: list[str] | None = None) -> DataFrame:
    """Contacts of two criteria; those close in time become one of kind ``both`` (the first kind's row stays)."""
    own = key or []
    one = a.select(*own, "frame", "t", "mx", "my").withColumn("kind", F.lit("angle")).unionByName(b.select(*own, "frame", "t", "mx", "my").withColumn("kind", F.lit("acceleration")))

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for r in g.sort_values(["t", "kind"]).to_dict("records"):
            if rows and r["t"] - rows[-1]["t"] <= apart_s:
                if rows[-1]["kind"] != r["kind"]:
                    rows[-1]["kind"] = "both"
            else:
                rows.append(r)
        return pd.DataFrame(rows, columns=list(g.columns))

    return one.groupBy(*own).applyInPandas(merged, one.schema)


def flight_lines(track: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Aerial rows on the line, by time, between the ground rows before and after them; measured no more."""
    # what follows is what comes before in the reverse order: a window up to the end reads it anew for each row
    w, back = (W.partitionBy(*(key or [])).orderBy(o) for o in (F.asc("frame"), F.desc("frame")))
    ground = lambda c: F.when(~F.col("aerial"), F.col(c))
    ends = {}
    for c in ("t", "mx", "my"):
        ends[f"_a_{c}"] = F.last(ground(c), True).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
        ends[f"_b_{c}"] = F.last(ground(c), True).over(back.rangeBetween(W.unboundedPreceding, W.currentRow))
    s = track.withColumns(ends)
    share = (F.col("t") - F.col("_a_t")) / (F.col("_b_t") - F.col("_a_t"))
    both = F.col("aerial") & F.col("_a_t").isNotNull() & F.col("_b_t").isNotNull() & (F.col("_b_t") > F.col("_a_t"))
    line = lambda c: F.when(both, F.col(f"_a_{c}") + share * (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).otherwise(F.col(c))
    return s.withColumns({"fx": line("mx"), "fy": line("my"), "es_real": F.when(F.col("aerial"), 0).otherwise(1)}).drop(*ends)


def fill(track: DataFrame, frames: DataFrame, line_s: float = 1.2, line_v: float = 12.0, line_x: float = 20.0, hold_s: float = 0.4, hold_v: float = 4.0, step: int = 2, key: list[str] | None = None) -> DataFrame:
    """Missing ball frames: the line to the next row if the gap is short, slow and far from the near goal; else the last place for a moment."""
    own = key or []
    w = W.partitionBy(*own).orderBy("frame")
    led = track.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("frame", "t", "mx", "my")}).where(F.col("n_frame") - F.col("frame") > step)
    gap = F.col("n_t") - F.col("t")
    v = F.sqrt((F.col("n_mx") - F.col("mx")) ** 2 + (F.col("n_my") - F.col("my")) ** 2) / gap
    how = F.when((gap <= line_s) & (v <= line_v) & ((F.col("mx") + F.col("n_mx")) / 2 >= line_x), "line").when((gap <= hold_s) & (v <= hold_v), "hold")
    inner = led.withColumn("how", how).where("how is not null").withColumn("f", F.explode(F.sequence(F.col("frame") + step, F.col("n_frame") - step, F.lit(step))))
    placed = inner.join(frames.select(*own, F.col("frame").alias("f"), F.col("t").alias("ft")).distinct(), [*own, "f"])
    share = F.when(F.col("how") == "line", (F.col("ft") - F.col("t")) / gap).otherwise(0.0)
    return placed.select(*own, F.col("f").alias("frame"), F.col("ft").alias("t"), (F.col("mx") + share * (F.col("n_mx") - F.col("mx"))).alias("mx"), (F.col("my") + share * (F.col("n_my") - F.col("my"))).alias("my"), "how")


def quality(out: Column, aerial_: Column, measured: Column) -> Column:
    """The first that holds: out, aerial, filled, measured."""
    return F.when(out, "out").when(aerial_, "aerial").when(~measured, "filled").otherwise("measured")


def possession(track: DataFrame, people: DataFrame, reach_m: float = 3.0, tolerance_s: float = 0.2, key: list[str] | None = None) -> DataFrame:
    """Who is nearest to the ball at its nearest instant of positions, within reach; ``key``: columns of the match."""
    own = key or []
    times = people.select(*own, "frame", "tiempo_s").distinct()
    at = islands.nearest_in_time(track.select(*own, "frame", "t", "mx", "my"), times, tolerance_s, "t", "tiempo_s", ["frame"], key=own)
    p = people.where(F.col("equipo").isin(0, 1)).select(*(F.col(c).alias(f"p_{c}") for c in own), F.col("frame").alias("p_frame"), "id_jugador", "equipo", F.col("x_m").alias("p_x"), F.col("y_m").alias("p_y"))
    away = F.sqrt((F.col("mx") - F.col("p_x")) ** 2 + (F.col("my") - F.col("p_y")) ** 2)
    on = (F.col("r_frame") == F.col("p_frame")) & (away <= reach_m)
    for c in own:
        on = on & (F.col(c) == F.col(f"p_{c}"))
    near = at.join(p, on)
    return near.groupBy(*own, "frame", "t", "mx", "my").agg(F.min_by(F.struct("id_jugador", "equipo", away.alias("player_m")), F.struct(away, F.col("id_jugador"))).alias("b")).select(*own, "frame", "t", "mx", "my", "b.id_jugador", "b.equipo", "b.player_m")


def possession_share(owned_rows: DataFrame, track: DataFrame, length: float = 100.0, zones: int = 3) -> DataFrame:
    """Share of each team, every frame weighted by the inverse of how often its zone's balls find an owner."""
    zone = F.least(F.greatest(F.floor(F.col("mx") * zones / length), F.lit(0)), F.lit(zones - 1)).cast("int").alias("zone")
    seen = track.groupBy(zone).agg(F.count("*").alias("seen"))
    got = owned_rows.groupBy(zone).agg(F.count("*").alias("got"))
    rate = seen.join(got, "zone").select("zone", (F.col("seen") / F.col("got")).alias("weight"))
    by = owned_rows.groupBy(zone, "equipo").agg(F.count("*").alias("n")).join(rate, "zone").groupBy("equipo").agg(F.sum("n").alias("frames"), F.sum(F.col("n") * F.col("weight")).alias("w"))
    return by.withColumn("share", fn.rounded(F.col("w") / F.sum("w").over(W.partitionBy()))).select("equipo", "frames", "share")


def possession_changes(owned_rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Where the owning team changes."""
    w = W.partitionBy(*(key or [])).orderBy("frame")
    return owned_rows.withColumn("before", F.lag("equipo").over(w)).where(F.col("before") != F.col("equipo")).select(*(key or []), "frame", "t", "before", F.col("equipo").alias("after"))


def ball_gaps(track: DataFrame, least_s: float = 1.0, most_s: float = 8.0, least_x: float = 0.0, key: list[str] | None = None) -> DataFrame:
    """Times without a ball that start far enough up the pitch."""
    w = W.partitionBy(*(key or [])).orderBy("frame")
    led = track.withColumn("until", F.lead("t").over(w)).withColumn("gap_s", F.col("until") - F.col("t"))
    return led.where((F.col("gap_s") > least_s) & (F.col("gap_s") < most_s) & (F.col("mx") >= least_x)).select(*(key or []), "frame", "t", "gap_s", "mx")


def combined(people: DataFrame, track: DataFrame) -> DataFrame:
    """Positions of people and ball in one table."""
    b = track.select("frame", F.col("t").alias("tiempo_s"), F.lit(-1).alias("id_jugador"), F.lit(3).alias("equipo"), F.lit("balon").alias("etiqueta"), F.col("mx").alias("x_m"), F.col("my").alias("y_m"))
    return people.unionByName(b, allowMissingColumns=True)


def anchored(track: DataFrame, radius_m: float = 0.5, key: str | None = None) -> DataFrame:
    """The longest time that the ball stays within a radius of the running mean of where it is."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        best, n, cx, cy, start = 0.0, 0, 0.0, 0.0, 0.0
        for t, x, y in g.sort_values("frame")[["t", "mx", "my"]].itertuples(index=False):
            if n and np.hypot(x - cx, y - cy) <= radius_m:
                n += 1
                cx, cy = cx + (x - cx) / n, cy + (y - cy) / n
                best = max(best, t - start)
            else:
                n, cx, cy, start = 1, x, y, t
        return pd.DataFrame({"longest_s": [best], **({key: [g[key].iloc[0]]} if key else {})})

    schema = "longest_s double"
    if key:
        schema += f", {key} {track.schema[key].dataType.simpleString()}"
    return track.groupBy(*([key] if key else [])).applyInPandas(run, schema)


def mark_share(track: DataFrame, marks: DataFrame, cell_px: int = 12) -> DataFrame:
    """Share of the chosen ball that lies on mark cells."""
    off = without_marks(track, marks, cell_px).agg(F.count("*").alias("off"))
    return track.agg(F.count("*").alias("n")).crossJoin(F.broadcast(off)).select("n", (F.col("n") - F.col("off")).alias("on_marks"), fn.rounded((F.col("n") - F.col("off")) / F.col("n")).alias("share"))


def merge_boxes(full: DataFrame, tiles: DataFrame, most_iou: float = 0.3) -> DataFrame:
    """Boxes of the whole image and those of its tiles that overlap no kept box of the frame too much, in order."""
    cols = ["frame", "box_idx", "x1", "y1", "x2", "y2"]
    both = full.select(*cols).withColumn("tile", F.lit(0)).unionByName(tiles.select(*cols).withColumn("tile", F.lit(1)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "tile", "box_idx"])
        kept: list[tuple] = []
        mask = []
        now = None
        for frame, tile, x1, y1, x2, y2 in g[["frame", "tile", "x1", "y1", "x2", "y2"]].itertuples(index=False):
            if frame != now:
                now, kept = frame, []
            ok = True
            for a1, b1, a2, b2 in kept if tile else ():
                inter = max(0.0, min(x2, a2) - max(x1, a1)) * max(0.0, min(y2, b2) - max(y1, b1))
                union = (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter
                if union > 0 and inter / union > most_iou:
                    ok = False
                    break
            mask.append(ok)
            if ok:
                kept.append((x1, y1, x2, y2))
        return g[cols + ["tile"]][np.array(mask, bool)]

    # a group is a range of frames: one for each frame costs more than its work
    dealt = both.withColumn("_range", F.floor(F.col("frame") / FRAMES))
    return dealt.groupBy("_range").applyInPandas(run, both.schema)
