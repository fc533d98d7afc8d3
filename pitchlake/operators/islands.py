"""Runs, gaps, steps and nearest times in ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def steps(rows: DataFrame, key: str | list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with ``prev_<c>`` of the row before it in its key."""
    window = W.partitionBy(key).orderBy(order)
    return rows.withColumns({f"prev_{c}": F.lag(c).over(window) for c in columns})


def runs(rows: DataFrame, key: str | list[str], order: str, value: Column, name: str = "run") -> DataFrame:
    """Each row with the number of its run of equal values; a null equals a null."""
    window = W.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_value", value)
    changed = F.when(F.col("_value").eqNullSafe(F.lag("_value").over(window)) & (F.row_number().over(window) > 1), 0).otherwise(1)
    return marked.withColumn("_change", changed).withColumn(name, F.sum("_change").over(window.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_value", "_change")


def coverage_holes(frames: DataFrame, sample: int, key: list[str] | None = None) -> DataFrame:
    """Consecutive frames further apart than the sampling step: ``before, after, missing``."""
    window = W.partitionBy(*(key or [])).orderBy("frame")
    led = frames.select(*(key or []), "frame").distinct().withColumn("after", F.lead("frame").over(window))
    return led.where(F.col("after") - F.col("frame") > sample).select(*(key or []), F.col("frame").alias("before"), "after", (F.floor((F.col("after") - F.col("frame")) / sample) - 1).cast("int").alias("missing"))


def speeds(rows: DataFrame, key: str = "id_jugador", t: str = "tiempo_s") -> DataFrame:
    """Each step of a trajectory with its time, length and speed (rows with a step before them only)."""
    stepped = steps(rows, key, "frame", ["frame", t, "x_m", "y_m"])
    moved = F.sqrt((F.col("x_m") - F.col("prev_x_m")) ** 2 + (F.col("y_m") - F.col("prev_y_m")) ** 2)
    dt = F.col(t) - F.col(f"prev_{t}")
    return stepped.where(dt > 0).withColumns({"dt": dt, "step_m": moved, "speed": moved / dt})


def fast_runs(rows: DataFrame, v_max: float = 8.5, least_s: float = 0.5, key: str = "id_jugador", t: str = "tiempo_s") -> DataFrame:
    """Maximal runs of consecutive steps faster than ``v_max`` that last ``least_s``: ``key, start_t, end_t``."""
    marked = runs(speeds(rows, key, t), key, "frame", F.col("speed") > v_max)
    out = marked.where(F.col("speed") > v_max).groupBy(key, "run").agg(F.min(f"prev_{t}").alias("start_t"), F.max(t).alias("end_t"), F.min("prev_frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    return out.where(F.col("end_t") - F.col("start_t") >= least_s).select(key, "start_frame", "end_frame", "start_t", "end_t")


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float, left_t: str = "t", right_t: str = "t", keep: list[str] | None = None, bucket_s: float | None = None, key: list[str] | None = None) -> DataFrame:
    """Each left row with the right row nearest in time, at most ``tolerance`` away; ties go to the earlier.

    Both sides fall into buckets of time of at least the tolerance; a right row
    is also offered to the buckets next to it, so an equi-join finds all
    candidates and one ``min_by`` picks the nearest. Neither side is sorted as a whole.
    """
    size = bucket_s or max(tolerance, 1e-6)
    keep = keep if keep is not None else right.columns
    key = key or []
    names = [f"r_{c}" for c in keep]
    offered = right.select(*(F.col(c).alias(f"rk_{c}") for c in key), F.col(right_t).alias("_rt"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.explode(F.sequence(F.floor(F.col(right_t) / size) - 1, F.floor(F.col(right_t) / size) + 1)).alias("_rb"))
    asking = left.withColumns({"_b": F.floor(F.col(left_t) / size), "_id": F.monotonically_increasing_id()})
    on = (F.col("_b") == F.col("_rb")) & (F.abs(F.col(left_t) - F.col("_rt")) <= tolerance)
    for c in key:
        on = on & (F.col(c) == F.col(f"rk_{c}"))
    near = asking.join(offered, on, "left")
    order = F.struct(F.abs(F.col(left_t) - F.col("_rt")).alias("d"), F.col("_rt").alias("t"))
    best = near.groupBy("_id", *left.columns).agg(F.min_by(F.struct("_rt", *names), order).alias("_best"))
    return best.select(*left.columns, F.col("_best._rt").alias("r_time"), *(F.col(f"_best.{n}").alias(n) for n in names))


def range_candidates(tracklets: DataFrame, max_gap: float, key: list[str] | None = None) -> DataFrame:
    """Pairs (a, b) where b starts within (end of a, end of a + max_gap], both of the same ``key``.

    ``tracklets``: ``tracklet_id, t0, t1`` and more. Starts and ends fall into
    buckets of ``max_gap``: an equi-join on at most two buckets replaces a
    nested loop over all pairs.
    """
    a = tracklets.select(*(F.col(c).alias(f"a_{c}") for c in tracklets.columns)).withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor(F.col("a_t1") / max_gap), F.floor((F.col("a_t1") + max_gap) / max_gap)))))
    b = tracklets.select(*(F.col(c).alias(f"b_{c}") for c in tracklets.columns)).withColumn("_b_bucket", F.floor(F.col("b_t0") / max_gap))
    inside = (F.col("b_t0") > F.col("a_t1")) & (F.col("b_t0") <= F.col("a_t1") + max_gap) & (F.col("a_tracklet_id") != F.col("b_tracklet_id"))
    for c in key or []:
        inside = inside & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return a.join(b, (F.col("_bucket") == F.col("_b_bucket")) & inside).drop("_bucket", "_b_bucket").withColumn("gap", F.col("b_t0") - F.col("a_t1"))


def pair_overlap(rows: DataFrame, least_frames: int = 1, key: str = "id_jugador") -> DataFrame:
    """Pairs of identities on shared frames: how many, and their median distance."""
    a = rows.select("frame", F.col(key).alias("id_a"), F.col("x_m").alias("ax"), F.col("y_m").alias("ay"))
    b = rows.select(F.col("frame").alias("b_frame"), F.col(key).alias("id_b"), F.col("x_m").alias("bx"), F.col("y_m").alias("by"))
    met = a.join(b, (F.col("frame") == F.col("b_frame")) & (F.col("id_a") < F.col("id_b")))
    distance = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return met.groupBy("id_a", "id_b").agg(F.count("*").alias("shared"), F.median(distance).alias("median_m")).where(F.col("shared") >= least_frames)


def nearest_other(rows: DataFrame, who: Column | None = None, key: str = "id_jugador") -> DataFrame:
    """Each row's distance to the nearest other row of its frame; ``who`` restricts pairs (columns ``equipo`` and ``o_equipo``)."""
    o = rows.select(F.col("frame").alias("o_frame"), F.col(key).alias("o_id"), F.col("equipo").alias("o_equipo"), F.col("x_m").alias("o_x"), F.col("y_m").alias("o_y"))
    on = (F.col("frame") == F.col("o_frame")) & (F.col(key) != F.col("o_id"))
    met = rows.join(o, on if who is None else on & who, "left")
    distance = F.sqrt((F.col("x_m") - F.col("o_x")) ** 2 + (F.col("y_m") - F.col("o_y")) ** 2)
    return met.groupBy("frame", key).agg(F.min(distance).alias("nearest_m"))
