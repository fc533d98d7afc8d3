"""Filters of detections, positions and ball candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn


def by_confidence(dets: DataFrame, least: float, reindex: bool = False) -> DataFrame:
    """Detections of at least a confidence (0 or less: all); ``det_idx`` stays, ``new_idx`` counts what is left of a frame."""
    kept = dets if least <= 0 else dets.where(F.col("conf") >= least)
    if not reindex:
        return kept
    return kept.withColumn("new_idx", (F.row_number().over(W.partitionBy("frame").orderBy("det_idx")) - 1).cast("int"))


def by_box(dets: DataFrame, least_conf: float, most_area: float, width: int, height: int) -> DataFrame:
    """Detections that are sure enough and cover at most a share of the image."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return dets.where((F.col("conf") >= least_conf) & (area <= most_area * width * height))


def by_implied_size(dets: DataFrame, h: fn.Homography, low_h: float = 0.0, high_h: float = 0.0, low_w: float = 0.0, high_w: float = 0.0) -> DataFrame:
    """Detections whose implied size is within shares of the median implied height (a share of 0 is off); no scale keeps a row."""
    tall, wide = fn.implied_size(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), h)
    sized = dets.withColumns({"tall_m": tall, "wide_m": wide})
    median = sized.where(F.col("tall_m") > 0).agg(F.median("tall_m").alias("median_m"))
    both = sized.crossJoin(F.broadcast(median))  # one row
    fits = F.lit(True)
    for value, low, high in (("tall_m", low_h, high_h), ("wide_m", low_w, high_w)):
        if low > 0:
            fits = fits & (F.col(value) >= low * F.col("median_m"))
        if high > 0:
            fits = fits & (F.col(value) <= high * F.col("median_m"))
    return both.where(F.col("tall_m").isNull() | F.col("median_m").isNull() | fits)


def on_pitch(rows: DataFrame, length: float, width: float, margin: float = 0.0, x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Rows within the pitch and a margin, edges included."""
    return rows.where(F.col(x).between(-margin, length + margin) & F.col(y).between(-margin, width + margin))


def credible(rows: DataFrame, most_age_s: float = 0.6, least_life_s: float = 2.0) -> DataFrame:
    """What a replay may show: identities whose measured rows span enough time, and no row too far in time from a measured one of its identity. Ball rows pass."""
    ball = F.col("etiqueta").startswith("balon")
    real_t = F.when(F.col("es_real") == 1, F.col("tiempo_s"))
    whole = W.partitionBy("id_jugador")
    # what follows is what comes before in the reverse order: a window up to the end reads it anew for each row
    before, after = (whole.orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in (F.asc("tiempo_s"), F.desc("tiempo_s")))
    aged = rows.withColumns({
        "_life": F.max(F.when(~ball, real_t)).over(whole) - F.min(F.when(~ball, real_t)).over(whole),
        "_age": F.least(F.col("tiempo_s") - F.last(real_t, ignorenulls=True).over(before), F.last(real_t, ignorenulls=True).over(after) - F.col("tiempo_s")),
    })
    keep = ball | ((F.col("_life") >= least_life_s) & ((F.col("es_real") == 1) | (F.col("_age") <= most_age_s)))
    return aged.where(keep).drop("_life", "_age")


def in_zone(rows: DataFrame, vertices: Sequence[tuple[float, float]], x: str = "mx", y: str = "my") -> DataFrame:
    """Rows inside a polygon."""
    return rows.where(fn.in_polygon(F.col(x), F.col(y), vertices))


def without_staff_balls(cands: DataFrame, people: DataFrame, length: float, width: float, least_player_m: float = 3.0) -> DataFrame:
    """Ball candidates less those off the pitch, nearer to staff than to any player, and far from players."""
    p = people.select(F.col("frame").alias("p_frame"), F.col("x_m").alias("p_x"), F.col("y_m").alias("p_y"), (F.col("etiqueta") == "staff").alias("is_staff"))
    away = F.sqrt((F.col("mx") - F.col("p_x")) ** 2 + (F.col("my") - F.col("p_y")) ** 2)
    near = cands.join(p, F.col("frame") == F.col("p_frame")).groupBy("frame", "cand_idx").agg(F.min(F.when(F.col("is_staff"), away)).alias("staff_m"), F.min(F.when(~F.col("is_staff"), away)).alias("player_m"))
    inf = F.lit(float("inf"))
    drop = (fn.edge_distance(F.col("mx"), F.col("my"), length, width) > 0) & (F.coalesce("staff_m", inf) < F.coalesce("player_m", inf)) & (F.coalesce("player_m", inf) > least_player_m)
    return cands.join(near, ["frame", "cand_idx"], "left").where(~F.coalesce(drop, F.lit(False)))


def hard_cut(selected: DataFrame, length: float, width: float, most_out_m: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """The chosen ball less rows far outside, and the frames that lost theirs."""
    out = fn.edge_distance(F.col("mx"), F.col("my"), length, width)
    return selected.where(out <= most_out_m), selected.where(out > most_out_m).select("frame").distinct()


def long_enough(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys with at least so many rows."""
    return rows.join(rows.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")


def max_overlap(dets: DataFrame, guard: float = 0.0) -> DataFrame:
    """``frame, det_idx, max_iou`` with the other boxes of the frame (0 if alone)."""
    boxes = ["x1", "y1", "x2", "y2"]
    o = dets.select(F.col("frame").alias("o_frame"), F.col("det_idx").alias("o_idx"), *(F.col(c).alias(f"o_{c}") for c in boxes))
    met = dets.join(o, (F.col("frame") == F.col("o_frame")) & (F.col("det_idx") != F.col("o_idx")), "left")
    value = fn.iou([F.col(c) for c in boxes], [F.col(f"o_{c}") for c in boxes], guard)
    return met.groupBy("frame", "det_idx").agg(F.coalesce(F.max(F.when(F.col("o_idx").isNotNull(), value)), F.lit(0.0)).alias("max_iou"))


def occluded(dets: DataFrame, least: float = 0.10) -> DataFrame:
    """Keys of detections that another box covers by more than a share."""
    return max_overlap(dets).where(F.col("max_iou") > least)


def frame_range(rows: DataFrame, fps: float, start_min: float = 0.0, length_s: float | None = None, most_frames: int | None = None) -> DataFrame:
    """Rows of a half-open range of frames, pushed down to the scan; frames stay global."""
    first = int(start_min * 60 * fps)
    ends = [first + n for n in (None if length_s is None else int(length_s * fps), most_frames) if n is not None]
    kept = rows.where(F.col("frame") >= first)
    return kept.where(F.col("frame") < min(ends)) if ends else kept
