"""Gap filling, smoothing and labels over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from . import islands


def fill_gaps(rows: DataFrame, frames: DataFrame, most_s: float, key: str = "id_jugador", step: int = 3) -> DataFrame:
    """Rows and, on the frames strictly inside gaps of at most ``most_s`` between measured rows, points of the line between them.

    ``frames``: the frames that exist, with ``tiempo_s``. Nothing lies outside
    an identity's first and last measured row. Frames come from a sequence and
    a semi-join, never from a range join.
    """
    w = W.partitionBy(key).orderBy("frame")
    real = rows.where("es_real = 1").select(key, "frame", "tiempo_s", "x_m", "y_m")
    led = real.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("frame", "tiempo_s", "x_m", "y_m")})
    gap = led.where((F.col("n_frame") - F.col("frame") > step) & (F.col("n_tiempo_s") - F.col("tiempo_s") <= most_s))
    inner = gap.withColumn("f", F.explode(F.sequence(F.col("frame") + step, F.col("n_frame") - step, F.lit(step))))
    share = (F.col("ft") - F.col("tiempo_s")) / (F.col("n_tiempo_s") - F.col("tiempo_s"))
    placed = inner.join(frames.select(F.col("frame").alias("f"), F.col("tiempo_s").alias("ft")).distinct(), "f")
    made = placed.select(key, F.col("f").alias("frame"), F.col("ft").alias("tiempo_s"), (F.col("x_m") + share * (F.col("n_x_m") - F.col("x_m"))).alias("x_m"), (F.col("y_m") + share * (F.col("n_y_m") - F.col("y_m"))).alias("y_m"), F.lit(0).alias("es_real"))
    return real.withColumn("es_real", F.lit(1)).unionByName(made)


def adaptive_gap(base_s: float, factor: Column, least_s: float = 1.0) -> Column:
    """The longest gap to fill where resolution is ``factor`` times worse than at its best."""
    return F.greatest(F.lit(least_s), base_s / F.sqrt(factor))


def _measured(rows: DataFrame, key: str | list[str]) -> tuple[DataFrame, W]:
    return rows.where("es_real = 1"), W.partitionBy(key).orderBy("frame")


def moving_average(rows: DataFrame, window: int, key: str | list[str] = "id_jugador") -> DataFrame:
    """Centred mean of measured rows; beyond its ends a trajectory counts as staying at its first and last point. Shorter ones stay."""
    half = window // 2
    real, w = _measured(rows, key)
    whole = W.partitionBy(key)
    at = real.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(whole)})
    inside = w.rowsBetween(-half, half)
    before, after = F.greatest(F.lit(half + 1) - F.col("_i"), F.lit(0)), F.greatest(F.col("_i") + half - F.col("_n"), F.lit(0))

    def mean(c: str) -> Column:
        ends = before * F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) + after * F.last(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return F.when(F.col("_n") < window, F.col(c)).otherwise((F.sum(c).over(inside) + ends) / window)

    return at.withColumns({"sx": mean("x_m"), "sy": mean("y_m")}).drop("_i", "_n")


def savitzky_golay(rows: DataFrame, window: int, key: str = "id_jugador") -> DataFrame:
    """A parabola's value at the middle of each window of measured rows; the ends stay."""
    half, weights = window // 2, fn.savitzky_golay_weights(window)
    real, w = _measured(rows, key)
    whole = W.partitionBy(key)

    def value(c: str) -> Column:
        total = F.lit(0.0)
        for k, weight in zip(range(-half, half + 1), weights, strict=True):
            total = total + weight * (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w)
        i, n = F.row_number().over(w), F.count("*").over(whole)
        return F.when((n >= window) & (i > half) & (i <= n - half), total).otherwise(F.col(c))

    return real.withColumns({"sx": value("x_m"), "sy": value("y_m")})


def within_time(rows: DataFrame, half_frames: int, key: str = "id_jugador") -> DataFrame:
    """Mean over a window of frames, whatever is missing in it."""
    real, _ = _measured(rows, key)
    w = W.partitionBy(key).orderBy("frame").rangeBetween(-half_frames, half_frames)
    return real.withColumns({"sx": F.avg("x_m").over(w), "sy": F.avg("y_m").over(w)})


def within_segments(rows: DataFrame, half_frames: int, v_cut: float = 8.5, key: str = "id_jugador") -> DataFrame:
    """The same, but not across steps faster than ``v_cut``."""
    real, w = _measured(rows, key)
    away = F.sqrt((F.col("x_m") - F.lag("x_m").over(w)) ** 2 + (F.col("y_m") - F.lag("y_m").over(w)) ** 2)
    cut = F.when(away > v_cut * (F.col("tiempo_s") - F.lag("tiempo_s").over(w)), 1).otherwise(0)
    seg = real.withColumn("_cut", cut).withColumn("seg", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    near = W.partitionBy(key, "seg").orderBy("frame").rangeBetween(-half_frames, half_frames)
    return seg.withColumns({"sx": F.avg("x_m").over(near), "sy": F.avg("y_m").over(near)}).drop("_cut")


def jitter(rows: DataFrame, band_m: float = 16.0, key: str = "id_jugador", step: int = 3) -> DataFrame:
    """Noise of positions by band of depth: the median absolute deviation of second differences over the square root of 6."""
    real, w = _measured(rows, key)
    near = (F.col("frame") - F.lag("frame").over(w) == step) & (F.lead("frame").over(w) - F.col("frame") == step)
    second = real.withColumns({"near": near, "d": F.lag("x_m").over(w) - 2 * F.col("x_m") + F.lead("x_m").over(w)}).where("near")
    band = second.withColumn("band", F.floor(F.col("y_m") / band_m).cast("int"))
    middle = band.groupBy("band").agg(F.median("d").alias("m"), F.count("*").alias("n"))
    return band.join(F.broadcast(middle), "band").groupBy("band", "n").agg(fn.rounded(1.4826 * F.median(F.abs(F.col("d") - F.col("m"))) / (6**0.5)).alias("sigma_m"))


def spread_labels(rows: DataFrame, label: str = "etiqueta", key: str = "id_jugador") -> DataFrame:
    """Rows that were not measured take the label of the nearest measured row of their identity by frame; of two as near, the earlier."""
    # what follows is what comes before in the reverse order: a window up to the end reads it anew for each row
    before, after = (W.partitionBy(key).orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in (F.asc("frame"), F.desc("frame")))
    real = lambda c: F.when(F.col("es_real") == 1, F.col(c))
    near = rows.withColumns({
        "_pf": F.last(real("frame"), True).over(before), "_pl": F.last(real(label), True).over(before),
        "_nf": F.last(real("frame"), True).over(after), "_nl": F.last(real(label), True).over(after),
    })
    earlier = F.col("_nf").isNull() | (F.col("frame") - F.col("_pf") <= F.col("_nf") - F.col("frame"))
    spread = F.when(F.col("es_real") == 1, F.col(label)).when(F.col("_pf").isNotNull() & earlier, F.col("_pl")).otherwise(F.col("_nl"))
    return near.withColumn("label", spread).drop("_pf", "_pl", "_nf", "_nl")


def visual_median(rows: DataFrame, label: str = "etiqueta", window: int = 3, key: str = "id_jugador") -> DataFrame:
    """What to paint: the label with a strict majority of a centred window of the data; else the label itself."""
    half = window // 2
    w = W.partitionBy(key).orderBy("frame")
    around = rows.withColumns({"_around": F.collect_list(label).over(w.rowsBetween(-half, half)), "_n": F.count("*").over(W.partitionBy(key))})
    votes = lambda x: F.size(F.filter("_around", lambda y: y == x))
    winner = F.get(F.filter("_around", lambda x: votes(x) * 2 > F.size("_around")), F.lit(0))
    return around.withColumn("shown", F.when(F.col("_n") >= window, F.coalesce(winner, F.col(label))).otherwise(F.col(label))).drop("_around", "_n")


def visual_hysteresis(rows: DataFrame, least_s: float = 1.0, label: str = "etiqueta", key: str = "id_jugador") -> DataFrame:
    """What to paint: a label from the first frame of a run that lasts ``least_s``; shorter runs keep the colour before. The first run is painted as it is."""
    w = W.partitionBy(key).orderBy("frame")
    step = rows.withColumn("_d", F.col("tiempo_s") - F.lag("tiempo_s").over(w)).groupBy(key).agg(F.median("_d").alias("_step"), F.max("tiempo_s").alias("_last"))
    marked = islands.runs(rows, key, "frame", F.col(label))
    by = marked.groupBy(key, "run").agg(F.min("tiempo_s").alias("start"), F.first(label).alias("value")).join(step, key)
    order = W.partitionBy(key).orderBy("run")
    end = F.coalesce(F.lead("start").over(order), F.col("_last") + F.coalesce("_step", F.lit(0.0)))
    held = F.when((F.col("run") == 1) | (end - F.col("start") >= least_s - 1e-9), F.col("value"))
    shown = by.withColumn("_held", held).withColumn("shown", F.last("_held", True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.join(shown.select(key, "run", "shown"), [key, "run"]).drop("run")


def moving_majority(rows: DataFrame, half_frames: int, label: str = "etiqueta", key: str = "id_jugador") -> DataFrame:
    """The most frequent label within a window of frames; of equally frequent ones the first by name."""
    w = W.partitionBy(key).orderBy("frame").rangeBetween(-half_frames, half_frames)
    around = rows.withColumn("_around", F.collect_list(label).over(w))
    ranked = F.array_sort(F.transform(F.array_distinct("_around"), lambda x: F.struct((-F.size(F.filter("_around", lambda y: y == x))).alias("n"), x.alias("label"))))
    return around.withColumn("majority", F.get(ranked, F.lit(0))["label"]).drop("_around")


def causal_hysteresis(rows: DataFrame, n: int, label: str = "etiqueta", key: str = "id_jugador") -> DataFrame:
    """A label is taken over once it has been seen n times in a row; until then the one before holds."""
    marked = islands.runs(rows, key, "frame", F.col(label))
    seen = marked.withColumn("_k", F.row_number().over(W.partitionBy(key, "run").orderBy("frame")))
    firm = F.when((F.col("_k") >= n) | (F.col("run") == 1), F.col(label))
    w = W.partitionBy(key).orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return seen.withColumn("_firm", firm).withColumn("held", F.last("_firm", True).over(w)).drop("_k", "_firm", "run")


def cut_by_speed(rows: DataFrame, v_max: float = 8.5, least_s: float = 0.5, v_jump: float | None = 60.0, least_rows: int = 3, key: str = "id_jugador") -> DataFrame:
    """Trajectories without impossible steps: a fast run of enough seconds, or one jump, is cut out; pieces with few rows go.

    A row belongs to a piece; the rows strictly inside a cut run go, its first
    row ends one piece and its last begins the next.
    """
    w = W.partitionBy(key).orderBy("frame")
    s = islands.steps(rows, key, "frame", ["tiempo_s", "x_m", "y_m"])
    speed = F.sqrt((F.col("x_m") - F.col("prev_x_m")) ** 2 + (F.col("y_m") - F.col("prev_y_m")) ** 2) / (F.col("tiempo_s") - F.col("prev_tiempo_s"))
    kind = F.when(F.col("prev_tiempo_s").isNull(), 0).when(F.lit(v_jump is not None) & (speed > (v_jump or 0.0)), 2).when(speed > v_max, 1).otherwise(0)
    s = s.withColumn("kind", kind)
    # a jump is a run of its own; a fast step joins the fast step before it
    prev = F.lag("kind").over(w)
    fresh = F.when((F.col("kind") == 1) & (prev == 1), 0).otherwise(1)
    s = s.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = W.partitionBy(key, "run")
    length = F.max("tiempo_s").over(r) - F.min("prev_tiempo_s").over(r)
    s = s.withColumn("bad", (F.col("kind") == 2) | ((F.col("kind") == 1) & (length >= least_s)))
    # a step's row starts a new piece if its step is bad; a row between two bad steps of one run is dropped
    nxt_bad, nxt_run = F.lead("bad").over(w), F.lead("run").over(w)
    s = s.withColumn("inner", F.col("bad") & F.coalesce(nxt_bad & (nxt_run == F.col("run")), F.lit(False)))
    s = s.withColumn("piece", F.sum(F.col("bad").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).where(~F.col("inner"))
    kept = s.withColumn("n", F.count("*").over(W.partitionBy(key, "piece"))).where(F.col("n") >= least_rows)
    return kept.select(*rows.columns, "piece")
