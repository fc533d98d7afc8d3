"""Readers and writers: detection caches, positions, annotations, benchmarks' text format.

All paths go through Spark's readers and writers, so any store that Spark can
open will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scans

BOX = "struct<mx:double,my:double,x1:double,y1:double,x2:double,y2:double,conf:double>"
CACHE = f"frame_idx int, t double, dets array<{BOX}>"
POSITIONS = "frame int, tiempo_s double, id_jugador int, equipo int, etiqueta string, x_m double, y_m double, es_real int"
DETECTION_FIELDS = ("mx", "my", "x1", "y1", "x2", "y2", "conf")


def read_cache(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Frames with nested detections, from Parquet or JSON lines."""
    return spark.read.schema(CACHE).format(form).load(path)


def flatten(cache: DataFrame) -> DataFrame:
    """A row for each detection; ``det_idx`` is its place in the frame and never changes afterwards."""
    return cache.select(F.col("frame_idx").alias("frame"), "t", F.posexplode("dets").alias("det_idx", "d")).select("frame", "t", "det_idx", *(F.col(f"d.{c}").alias(c) for c in DETECTION_FIELDS))


def nest(dets: DataFrame) -> DataFrame:
    """The other way round: frames with their detections in order."""
    item = F.struct("det_idx", *DETECTION_FIELDS)
    return dets.groupBy(F.col("frame").alias("frame_idx"), "t").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(*(s[c].alias(c) for c in DETECTION_FIELDS))).alias("dets"))


def structure_violations(columns: list[str], needed: tuple[str, ...] = ("frame_idx", "t", "dets")) -> list[str]:
    """Columns that a cache lacks."""
    return [c for c in needed if c not in columns]


def content_violations(dets: DataFrame, frames: DataFrame, sample: int, most_m: float = 300.0, most_empty: float = 0.95) -> DataFrame:
    """``rule, level, n`` for each rule that a cache breaks. ``frames``: every frame in its stored order, with ``seq``.

    Frames must grow, steps be multiples of the sampling step, most frames hold
    something, positions be in metres, confidences in [0, 1] and boxes upright;
    a long gap is a warning.
    """
    w = W.orderBy("seq")
    s = frames.withColumn("step", F.col("frame") - F.lag("frame").over(w))
    least = s.where("step > 0").agg(F.min("step").alias("least"))
    one = lambda df, rule, level, cond: df.agg(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.count(F.when(cond, 1)).alias("n"))
    rules = [one(s, "frames grow", "error", F.col("step") <= 0)]
    if sample > 1:
        rules.append(one(s, "steps fit the sample", "error", F.col("step") % sample != 0))
    rules.append(one(s.crossJoin(F.broadcast(least)), "long gap", "warning", F.col("step") > 5 * F.col("least")))
    filled = frames.select("frame").distinct().join(dets.groupBy("frame").agg(F.count("*").alias("n")), "frame", "left")
    empty = filled.agg((F.count(F.when(F.col("n").isNull(), 1)) > most_empty * F.count("*")).alias("bad"))
    rules.append(one(empty, "mostly empty", "error", F.col("bad")))
    for c in ("mx", "my"):
        far = dets.agg((F.median(F.abs(F.col(c))) > most_m).alias("bad"))
        rules.append(one(far, f"{c} in metres", "error", F.col("bad")))
    rules.append(one(dets, "confidence", "error", ~F.col("conf").between(0.0, 1.0)))
    rules.append(one(dets, "upright boxes", "error", (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionAll(r)
    return out.where("n > 0")


def merge_caches(parts: list[DataFrame], keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Partial tables as one: of equal keys the first table's rows stay. Each table keeps its frames whole."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    first = out.withColumn("_first", F.min("_part").over(W.partitionBy(*keys)))
    return first.where("_part = _first").drop("_part", "_first")


def same_metadata(meta: DataFrame, columns: tuple[str, ...] = ("fps", "sample", "width", "height")) -> DataFrame:
    """How many different settings the parts of a cache have; more than one must not be merged."""
    return meta.select(*columns).distinct().agg(F.count("*").alias("settings"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """A positions CSV; older ones without label or ``es_real`` get a null label and count as measured."""
    found = spark.read.option("header", True).csv(path)
    kinds = dict(x.split(" ") for x in POSITIONS.split(", "))
    default = {"etiqueta": F.lit(None), "es_real": F.lit(1)}
    return found.select(*((F.col(c) if c in found.columns else default[c]).cast(k).alias(c) for c, k in kinds.items()))


def write_positions(rows: DataFrame, path: str, partition: str | None = None, margin: tuple[float, float, float] | None = None) -> DataFrame:
    """Positions as CSV in order of frame and identity (Parquet by ``partition`` at scale); returns its summary.

    margin: length, width and the metres beyond them that are still exported.
    """
    if margin is not None:
        length, width, m = margin
        rows = rows.where(F.col("x_m").between(-m, length + m) & F.col("y_m").between(-m, width + m))
    if partition:
        rows.repartition(partition).sortWithinPartitions(partition, "frame", "id_jugador").write.mode("overwrite").partitionBy(partition).parquet(path)
    else:
        rows.orderBy("frame", "id_jugador").write.mode("overwrite").option("header", True).csv(path)
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("id_jugador").alias("ids"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def read_cvat(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of an annotation file (XML, one ``track`` a person); those marked outside go; the team is the box's, else the track's first."""
    schema = "_id long, _label string, box array<struct<_frame:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double,_outside:int,attribute:array<struct<_name:string,_VALUE:string>>>>"
    tracks = spark.read.format("xml").option("rowTag", "track").schema(schema).load(path)
    boxes = tracks.select(F.col("_id").alias("obj_id"), F.col("_label").alias("label"), F.explode("box").alias("b"))
    own = F.get(F.filter("b.attribute", lambda a: a["_name"] == "team"), F.lit(0))["_VALUE"]
    rows = boxes.select("obj_id", "label", F.col("b._frame").alias("frame"), F.col("b._xtl").alias("x1"), F.col("b._ytl").alias("y1"), F.col("b._xbr").alias("x2"), F.col("b._ybr").alias("y2"), F.col("b._outside").alias("outside"), F.nullif(F.trim(own), F.lit("")).alias("own"))
    w = W.partitionBy("obj_id").orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("team", F.coalesce("own", F.first("own", True).over(w))).where("outside = 0").drop("own", "outside")


_TRACKS = "array<struct<_frame:int,_outside:int,_occluded:int,_keyframe:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:array<struct<_name:string,_VALUE:string>>>>"


def cvat_tracks(clicks: DataFrame, tall: float = 40.0, wide: float = 18.0) -> DataFrame:
    """Clicks on feet (``frame, obj_id, px, py, team``) as an annotation's tracks: a row a person with its boxes by frame.

    The click is the middle of a box's lower edge. Frames and persons are numbered
    from 0 in their order; pixels have two digits. A person's team is the first by frame
    that is known; ``referee`` becomes the track's label, others an attribute of each box.
    """
    frames = scans.numbered(clicks.select("frame").distinct(), "frame", "_f")
    people = scans.numbered(clicks.select("obj_id").distinct(), "obj_id", "_n")
    team = clicks.groupBy("obj_id").agg(F.min_by("team", F.when(F.col("team").isNotNull(), F.col("frame"))).alias("_team")).withColumnRenamed("obj_id", "_who")
    rows = clicks.join(frames, "frame").join(people, "obj_id").join(team, F.col("obj_id") == F.col("_who"))
    place = lambda c: F.floor(c * 100 + 0.5) / 100
    named = F.struct(F.lit("team").alias("_name"), F.col("_team").alias("_VALUE"))
    has = F.col("_team").isNotNull() & (F.col("_team") != "referee")
    box = F.struct(
        (F.col("_f") - 1).cast("int").alias("_frame"), F.lit(0).alias("_outside"), F.lit(0).alias("_occluded"), F.lit(1).alias("_keyframe"), place(F.col("px") - wide / 2).alias("_xtl"), place(F.col("py") - tall).alias("_ytl"),
        place(F.col("px") + wide / 2).alias("_xbr"), place(F.col("py")).alias("_ybr"), F.when(has, F.array(named)).alias("attribute"),
    )
    label = F.when(F.col("_team") == "referee", "referee").otherwise("player")
    return rows.groupBy((F.col("_n") - 1).alias("_id"), label.alias("_label"), F.lit("manual").alias("_source")).agg(F.sort_array(F.collect_list(box)).cast(_TRACKS).alias("box"))


def write_cvat(tracks: DataFrame, path: str) -> None:
    """Tracks as XML files of one root each; a person's track stays in one file."""
    tracks.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "track").option("declaration", 'version="1.0" encoding="UTF-8"').save(path)


def feet(boxes: DataFrame, h, offset: int = 0, step: int = 1) -> DataFrame:
    """Annotated boxes as observations: global frame, and the foot's place in metres."""
    from ..functions import project

    x, y = project((F.col("x1") + F.col("x2")) / 2, F.col("y2"), h)
    return boxes.select((F.col("frame") * step + offset).alias("frame"), "obj_id", x.alias("x_m"), y.alias("y_m"), "team", "label")


def mot_rows(obs: DataFrame, box_m: float = 2.0, key: list[str] | None = None) -> DataFrame:
    """Observations as lines of the MOT challenge format: frames 1 to N (of each match, ``key``), square boxes in metres."""
    own = key or []
    if own:
        b = obs.withColumn("n", F.dense_rank().over(W.partitionBy(*own).orderBy("frame")))
    else:
        b = obs.join(scans.numbered(obs.select("frame").distinct(), "frame"), "frame")
    return b.select(*own, F.col("n").cast("int").alias("frame"), F.col("obj_id").alias("id"), (F.col("x_m") - box_m / 2).alias("left"), (F.col("y_m") - box_m / 2).alias("top"), F.lit(box_m).alias("width"), F.lit(box_m).alias("height"), F.lit(1).alias("conf"))


def write_mot(obs: DataFrame, path: str, box_m: float = 2.0) -> None:
    mot_rows(obs, box_m).orderBy("frame", "id").write.mode("overwrite").csv(path)


def signature(settings: dict[str, str], homography: list[list[float]]) -> str:
    """A digest of what a detection run depends on; the homography counts by content."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([sorted(settings.items()), homography], separators=(",", ":")).encode()).hexdigest()


def left_to_do(frames: DataFrame, done: DataFrame, own: str, saved: str | None) -> DataFrame:
    """Frames that a run still has to do: those not done under the same signature; another signature starts anew."""
    return frames if own != saved else frames.join(done.select("frame"), "frame", "left_anti")


def write_pair(features: DataFrame, dets: DataFrame, path: str) -> None:
    """Features first, detections last: a finished detections folder (its ``_SUCCESS``) means that both are there."""
    features.write.mode("overwrite").parquet(f"{path}/features")
    dets.write.mode("overwrite").parquet(f"{path}/detections")


def segments(spark: SparkSession, seconds: float, length: float, overlap: float) -> DataFrame:
    """Overlapping segments that cover a match."""
    step = length - overlap
    n = max(1, int(-(-max(seconds - overlap, 0.0) // step)))
    return spark.range(n).select(F.col("id").cast("int").alias("segment"), (F.col("id") * step).alias("start_s"), F.least(F.col("id") * step + length, F.lit(float(seconds))).alias("end_s"))


def nearest_meta(spark: SparkSession, names: list[str], wanted: str) -> DataFrame:
    """Metadata files by how alike their names are."""
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", F.levenshtein("name", F.lit(wanted)).alias("edits")).orderBy("edits", "name").limit(1)


def metrics_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def clean_ball(cands: DataFrame, length: float, width: float, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Plausible candidates off static marks, and the ones off the pitch that were set aside (less marks)."""
    from ..operators.ball import plausible, static_marks, without_marks

    marks = static_marks(cands) if marks is None else marks
    kept = without_marks(plausible(cands, length, width), marks)
    aside = without_marks(cands.join(plausible(cands, length, width).select("frame", "cand_idx"), ["frame", "cand_idx"], "left_anti"), marks)
    return kept, aside


