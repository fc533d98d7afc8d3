"""A match longer than one task: trackers over overlapping stretches, and their identities put together.

Each stretch is a group of its own. Two neighbours both see the rows of their
overlap; identities that share most of them are one. A row belongs to the
stretch that is farther from its end there: the overlap is cut in the middle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import saved
from .tracking import components

#: More identities than a stretch can have.
ROOM = 1_000_000_000


def spread(rows: DataFrame, seconds: float, overlap: float, key: str | None = None) -> DataFrame:
    """``rows`` in each stretch that has them: ``stretch`` (from 0 in each match) and ``_group``, one number a match and stretch.

    Stretches start every ``seconds - overlap``; the overlap is at most half of one, so a row has two at most.
    """
    step = seconds - overlap
    if overlap < 0 or overlap * 2 > seconds:
        raise ValueError("the overlap must be at most half a stretch")
    last = F.floor(F.col("t") / step).cast("int")
    both = F.when((last > 0) & (F.col("t") - last * step < overlap), F.array(last - 1, last)).otherwise(F.array(last))
    by = F.concat_ws(":", *([F.col(key).cast("string")] if key else []), F.col("stretch").cast("string"))
    return rows.withColumn("stretch", F.explode(both)).withColumn("_group", by)


def agreement(tracked: DataFrame) -> DataFrame:
    """Pairs of identities of neighbouring stretches by the rows they share: ``match, a_stretch, a, b, shared`` and whether each is the other's best.

    tracked: ``match, stretch, tracklet_id, frame, det_idx``. Of equals the least identity is the best.
    """
    cols = ("match", "stretch", "tracklet_id", "frame", "det_idx")
    a, b = (tracked.select(*(F.col(c).alias(f"{s}_{c}") for c in cols)) for s in ("a", "b"))
    same = a["a_match"].eqNullSafe(b["b_match"]) & (a["a_frame"] == b["b_frame"]) & (a["a_det_idx"] == b["b_det_idx"]) & (a["a_stretch"] + 1 == b["b_stretch"])
    pairs = a.join(b, same).groupBy(F.col("a_match").alias("match"), "a_stretch", F.col("a_tracklet_id").alias("a"), F.col("b_tracklet_id").alias("b")).agg(F.count("*").alias("shared"))
    first = lambda own, other: F.row_number().over(W.partitionBy("match", "a_stretch", own).orderBy(F.desc("shared"), other)) == 1
    return pairs.withColumn("mutual", first("a", "b") & first("b", "a"))


def tracked_in_stretches(dets: DataFrame, tracker: Callable[[DataFrame, str], DataFrame], seconds: float = 300.0, overlap: float = 20.0, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``tracker`` (of rows and the column that groups them) finds, with identities over the whole of each match, and the pairs that were not joined.

    An identity is the least number among its parts; numbers are 64-bit. Equal to one
    run but for tracks whose state before a stretch's start reaches over the overlap,
    and for the pairs returned: they share rows, but not most of them.
    """
    rows = spread(dets, seconds, overlap, key)
    groups = rows.select("_group", *([F.col(key).alias("match")] if key else [F.lit(None).cast("int").alias("match")]), "stretch").distinct()
    found = tracker(rows, "_group")
    found = saved(found.join(groups, "_group").drop("_group"))
    pairs = saved(agreement(found))
    numbered = lambda stretch, tracklet: F.struct(F.col("match"), (F.col(stretch).cast("bigint") * F.lit(ROOM) + F.col(tracklet)).alias("id"))
    whole = found.withColumn("_id", numbered("stretch", "tracklet_id"))
    links = pairs.where("mutual").withColumns({"a": numbered("a_stretch", "a"), "b": F.struct(F.col("match"), ((F.col("a_stretch").cast("bigint") + 1) * F.lit(ROOM) + F.col("b")).alias("id"))})
    joined = components(whole.select(F.col("_id").alias("tracklet_id")).distinct(), links.select("a", "b")).withColumnsRenamed({"tracklet_id": "_of"})
    # the middle of the overlap with the stretch before, and with the one after
    step = seconds - overlap
    own = (F.col("stretch") == 0) | (F.col("t") >= F.col("stretch") * step + overlap / 2)
    own &= F.col("t") < (F.col("stretch") + 1) * step + overlap / 2
    # a row that only the other stretch has tracked stays
    there = W.partitionBy("match", "frame", "det_idx").orderBy(F.desc("_own"), "stretch")
    told = whole.withColumn("_own", own).withColumn("_r", F.row_number().over(there)).where("_r = 1")
    kept = told.join(joined, told["_id"] == joined["_of"])
    cols = [F.col("identity_id.id").alias("identity_id"), *(told[c] for c in found.columns if c not in ("match", "tracklet_id"))]
    return kept.select(*([told["match"].alias(key)] if key else []), *cols), pairs.where("not mutual")
