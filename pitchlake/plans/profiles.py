"""Profiles: which steps lead from detections to positions, in which order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, smoothing, tracking
from ..operators.lineage import saved
from . import matches

#: A cut trajectory's pieces are numbered below this.
PIECES = 1000

#: Fixed names of the three profiles and what they differ in.
PROFILES = {
    "oficial": {"tracker": "conservative", "choice": "greedy", "merge": False, "repair": True},
    "candidato": {"tracker": "conservative", "choice": "global", "merge": True, "repair": True},
    "bytetrack": {"tracker": "box", "choice": "none", "merge": False, "repair": False},
}


@dataclass(frozen=True)
class Profile:
    """Settings of one profile; steps are switched on and off by name."""

    name: str = "candidato"
    least_conf: float = 0.0
    dt: float = 0.12
    step: int = 3
    fill_s: float = 0.5
    smooth: int = 5
    most_duplicate_m: float = 1.5
    conservative: tracking.Conservative = field(default_factory=tracking.Conservative)
    #: A task's piece of a single match; matches of a season are a group each.
    piece_s: float = 120.0


def identities(dets: DataFrame, p: Profile, key: str | None = None) -> DataFrame:
    """Observations under identities: tracker, stitching and merging as the profile says; with ``key``, frames and identities unique over matches."""
    how = PROFILES[p.name]
    kept = filters.by_confidence(dets, p.least_conf)
    seconds = p.piece_s if key is None else None
    obs = tracking.conservative_tracker(kept, p.dt, p.conservative, key, seconds) if how["tracker"] == "conservative" else tracking.box_tracker(kept, key=key, seconds=seconds)
    obs = saved(obs if key is None else matches.lifted(obs, key, ids=("tracklet_id",)))
    match = [key] if key else None
    rows = obs
    if how["choice"] != "none":
        links = tracking.choose_links(tracking.stitch_candidates(tracking.summaries(obs, match), key=match), how["choice"], key=key)
        named = tracking.components(obs.select("tracklet_id").distinct(), links)
        rows = obs.join(named, "tracklet_id")
    else:
        rows = obs.withColumn("identity_id", F.col("tracklet_id"))
    out = rows.select("frame", F.col("t").alias("tiempo_s"), F.col("identity_id").alias("id_jugador"), "x_m", "y_m", F.lit(1).alias("es_real"))
    if how["merge"]:
        out = saved(out)
        out = tracking.merge_identities(out, tracking.duplicates(out, 3, p.most_duplicate_m))
    return out


def finished(rows: DataFrame, frames: DataFrame, p: Profile) -> DataFrame:
    """Smooth, merge, cut, fill, in this order; a profile without repairs only fills gaps."""
    if PROFILES[p.name]["repair"]:
        s = smoothing.moving_average(rows, p.smooth)
        rows = s.select(*(c for c in rows.columns if c not in ("x_m", "y_m")), F.col("sx").alias("x_m"), F.col("sy").alias("y_m"))
        rows = saved(rows)
        rows = tracking.merge_identities(rows, tracking.duplicates(rows, 3, p.most_duplicate_m))
        cut = smoothing.cut_by_speed(rows)
        rows = cut.withColumn("id_jugador", (F.col("id_jugador") * PIECES + F.col("piece")).cast(rows.schema["id_jugador"].dataType)).drop("piece")
    return smoothing.fill_gaps(rows, frames, p.fill_s, step=p.step)


def run(dets: DataFrame, p: Profile | None = None) -> DataFrame:
    """From detections to positions."""
    p = p or Profile()
    frames = dets.select("frame", F.col("t").alias("tiempo_s")).distinct()
    return finished(identities(dets, p), frames, p)


def run_matches(dets: DataFrame, p: Profile | None = None, key: str = "match_no") -> DataFrame:
    """Positions of every match of a table in one job: what each match alone would give, with its ``key``.

    Frames and identities are lifted, so that no step can mix two matches; only
    trackers and choices of links take a match as a group.
    """
    p = p or Profile()
    frames = matches.lifted(dets.select(key, "frame", F.col("t").alias("tiempo_s")).distinct(), key).select("frame", "tiempo_s")
    out = finished(identities(dets, p, key), frames, p)
    room = matches.ROOM * (PIECES if PROFILES[p.name]["repair"] else 1)
    number = F.floor(F.col("frame") / matches.ROOM).cast(dets.schema[key].dataType)
    return out.withColumns({key: number, "frame": F.pmod("frame", F.lit(matches.ROOM)).cast("int"), "id_jugador": F.pmod("id_jugador", F.lit(room)).cast("int")})
