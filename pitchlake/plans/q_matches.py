"""Operators that read a match in order, over many matches in one table.

A match is a stretch of ``LENGTH`` frame numbers of the given tables, so their
number grows with the data and a group keeps its size. Frames are unique over
matches, as ``matches.lifted`` makes them; identities are not, and operators get
the match as their ``key``. The SQL of such a query is that of one match, run
for each match alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources
from ..operators import ball, crossings, evaluation, islands, metrics, review, teams, tracking
from . import fixtures, matches, profiles, q_metrics, q_review, q_sql, q_tracking
from .base import Query
from .q_review import _aerial, _crossed
from .q_tracking import _jumping, _pred, _q, _track, _tracklets

#: Frame numbers of a match: 24 seconds, so that the small tables have several matches.
LENGTH = 600
KEY = ["match_no"]


def of_match(rows: DataFrame) -> DataFrame:
    return rows.withColumn("match_no", F.floor(F.col("frame") / LENGTH).cast("int"))


def _over(*names: str):
    """A query over derived tables with their match."""
    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: f(*(of_match(fixtures.table(spark, sf_dir, n)) for n in names))

    return wrap


def each_match(one: str) -> str:
    """The SQL of a query over one match, for every match that its tables have, by itself."""
    numbers = []
    for name, text in fixtures.VIEWS.items():
        body = text.format(events="events", embeddings="embeddings")
        if f"{name} as ({body})" not in one:
            continue
        numbers.append(f"select distinct cast(floor(frame / {LENGTH}e0) as int) as match_no from ({body})")
        one = one.replace(f"{name} as ({body})", f"{name} as (select * from ({body}) where floor(frame / {LENGTH}e0) = m.match_no)")
    return f"select m.match_no, x.* from ({' union '.join(numbers)}) m, lateral ({one}) x"


def _named(obs: DataFrame) -> DataFrame:
    """Tracklets whose names are unique over matches."""
    return matches.lifted(obs, "match_no", ids=("tracklet_id",))


def _links(p: DataFrame, how: str, **kw) -> DataFrame:
    obs = _named(of_match(_tracklets(p)))
    found = tracking.choose_links(tracking.stitch_candidates(tracking.summaries(obs, KEY), key=KEY, **kw), how, key="match_no")
    lower = lambda c: F.pmod(c, F.lit(matches.ROOM)).cast("int").alias(c)
    return found.select(F.floor(F.col("a") / matches.ROOM).cast("int").alias("match_no"), lower("a"), lower("b"), fn.rounded(F.col("cost")).alias("cost"))


def _stitched(p: DataFrame) -> DataFrame:
    obs = _named(of_match(_tracklets(p)))
    names = tracking.purity_stitch(obs, key="match_no")
    return obs.select(*KEY, "tracklet_id").join(names, "tracklet_id").groupBy(*KEY, F.pmod("identity_id", F.lit(matches.ROOM)).cast("int").alias("identity_id")).agg(F.count("*").alias("n"))


def _relinked(p: DataFrame, d: DataFrame) -> DataFrame:
    rows = _crossed(p, d).withColumn("id_jugador", F.col("match_no") * 1000 + F.col("id_jugador"))
    out = crossings.relink(rows, match=KEY)
    return out.groupBy(*KEY, "piece_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("kept"), 1)).alias("kept")).groupBy(*KEY).agg(F.count("*").alias("chains"), F.sum("n").alias("n"), F.sum("kept").alias("kept"))


def _truth_frames(g: DataFrame, p: DataFrame) -> DataFrame:
    return _pred(p).join(g.select("frame").distinct(), "frame", "left_semi").transform(of_match)


def _objects(b: DataFrame) -> DataFrame:
    return ball.group_objects(b, key="match_no")


def _real(b: DataFrame) -> DataFrame:
    return b.where("cand_idx = 0")


def _contacts(b: DataFrame, p: DataFrame) -> DataFrame:
    return ball.merge_contacts(ball.contacts_by_angle(_real(b), p, 70.0, 1.0, key=KEY), ball.acceleration_peaks(_real(b), key="match_no"), key=KEY)


def _owned(b: DataFrame, p: DataFrame) -> DataFrame:
    return ball.possession(_real(b), p, 6.0, key=KEY)


#: By the name of the query over one match.
_KEYED: dict[str, Query] = {
    "worst_windows": _over("positions")(lambda p: review.worst_windows(p, key=KEY).select(*KEY, "start_s", fn.rounded(F.col("rate")).alias("rate"))),
    "play_score": _over("ball_cand")(lambda b: review.play_score(_real(b), key=KEY)),
    "readmitted_flights": _over("ball_cand")(lambda b: review.readmitted_flights(_aerial(b), key=KEY).select(*KEY, "frame", "readmitted")),
    "smooth_ball": _over("ball_cand")(lambda b: _q(review.smooth_ball(_aerial(b), key=KEY), "bx", "by", keep=(*KEY, "frame"))),
    "field_prior": _over("ball_cand")(lambda b: review.field_prior(b.withColumn("mx", F.when(F.col("frame") % 30 == 0, 150.0).otherwise(F.col("mx"))), 100.0, 64.0, key="match_no").select(*KEY, "frame", "cand_idx")),
    "ball_objects": _over("ball_cand")(lambda b: _objects(b).groupBy(*KEY, "object").agg(F.count("*").alias("n"))),
    "parked_balls": _over("ball_cand", "positions")(lambda b, p: ball.without_parked(_objects(b).withColumn("object", F.struct(*KEY, "object")), p).select(*KEY, "frame", "cand_idx")),
    "ball_segments": _over("ball_cand", "positions")(lambda b, p: ball.continuity_segments(of_match(_track(b, p)), key=KEY).select(*KEY, "frame", "segment")),
    "aerial_phases": _over("ball_cand")(lambda b: ball.aerial(_real(b), 20.0, 1.6, 0.0, 40.0, key=KEY).select(*KEY, "frame", "aerial")),
    "contacts_angle": _over("ball_cand", "positions")(lambda b, p: ball.contacts_by_angle(_real(b), p, 70.0, 1.0, 6.0, 0, key=KEY).select(*KEY, "frame", "id_jugador", fn.rounded(F.col("angle"), 5).alias("angle"))),
    "acceleration_peaks": _over("ball_cand")(lambda b: _q(ball.acceleration_peaks(_real(b), key="match_no"), "change", keep=(*KEY, "frame", "t", "mx", "my"))),
    "merged_contacts": _over("ball_cand", "positions")(_contacts),
    "flight_lines": _over("ball_cand")(lambda b: _q(ball.flight_lines(ball.aerial(_real(b), key=KEY), key=KEY), "fx", "fy", keep=(*KEY, "frame", "es_real"))),
    "ball_fill": _over("ball_cand")(lambda b: _q(ball.fill(_real(b).where("frame % 10 < 6"), b, key=KEY), "mx", "my", keep=(*KEY, "frame", "how"))),
    "possession_changes": _over("ball_cand", "positions")(lambda b, p: ball.possession_changes(_owned(b, p), key=KEY).select(*KEY, "frame", "before", "after")),
    "ball_gaps": _over("ball_cand")(lambda b: ball.ball_gaps(_real(b).where("frame % 100 < 60"), 1.0, 8.0, 20.0, key=KEY).select(*KEY, "frame", fn.rounded(F.col("gap_s")).alias("gap_s"))),
    "anchored_ball": _over("ball_cand")(lambda b: ball.anchored(b.where("cand_idx = 1"), key="match_no")),
    "ball_anchor_share": _over("ball_cand")(lambda b: ball.anchored(_real(b), 3.0, key="match_no")),
    "one_referee": _over("positions")(lambda p: teams.one_referee(p, key=KEY)),
    "coverage_holes": _over("detections")(lambda d: islands.coverage_holes(d.where("frame % 90 < 75"), 3, key=KEY)),
    "active_identities": _over("positions")(lambda p: tracking.concurrency(p, p, match=KEY)),
    "densest_window": _over("positions")(lambda p: metrics.densest_window(p, key=KEY)),
    "weighted_quantile": _over("positions")(lambda p: metrics.weighted_quantile(p, "x_m", "id_jugador", 0.5, key=KEY)),
    "mot_export": _over("gt_obs")(lambda g: _q(sources.mot_rows(g, key=KEY), "left", "top", keep=(*KEY, "frame", "id", "width"))),
}

#: These have no SQL; tests hold them against each match alone.
_ALONE: dict[str, Query] = {
    "conservative_tracker": _over("detections")(lambda d: tracking.conservative_tracker(d, 0.12, key="match_no")),
    "appearance_tracker": _over("detections", "features")(lambda d, f: tracking.appearance_tracker(d.join(f.select("frame", "det_idx", F.col("feat").alias("emb")), ["frame", "det_idx"], "left"), key="match_no")),
    "stitch_greedy": _over("positions")(lambda p: _links(p, "greedy")),
    "stitch_global": _over("positions")(lambda p: _links(p, "global", tol=6.0)),
    "purity_stitch": _over("positions")(_stitched),
    "fused_cuts": _over("detections")(lambda d: tracking.fused_cuts(_named(of_match(_jumping(d))), 1.0).select(F.floor(F.col("frame") / matches.ROOM).cast("int").alias("match_no"), *(F.pmod(c, F.lit(matches.ROOM)).cast("int").alias(c) for c in ("tracklet_id", "frame")))),
    "relink_at_crossings": _over("positions", "detections")(_relinked),
    "profile_oficial": _over("detections")(lambda d: profiles.run_matches(d, profiles.Profile("oficial"))),
    "profile_candidato": _over("detections")(lambda d: profiles.run_matches(d)),
    "profile_bytetrack": _over("detections")(lambda d: profiles.run_matches(d, profiles.Profile("bytetrack"))),
    "hota": _over("gt_obs", "positions")(lambda g, p: evaluation.hota(g, _truth_frames(g, p), key="match_no")),
    "clear_mot": _over("gt_obs", "positions")(lambda g, p: evaluation.clear_mot(g, _truth_frames(g, p), key=KEY)),
    "ball_viterbi": _over("ball_cand")(lambda b: ball.best_path(b, key="match_no").select(*KEY, "frame", "cand_idx")),
    "referee_path": _over("detections")(lambda d: teams.referee_path(d.select(*KEY, "frame", "t", "det_idx", "mx", "my", F.when(F.col("det_idx") == 11, 1.0).otherwise(-1.0).alias("log_lr")), key="match_no")),
}

QUERIES: dict[str, Query] = {f"{name}_by_match": q for name, q in (_KEYED | _ALONE).items()}

_ONE = q_metrics.ORACLES | q_tracking.ORACLES | q_review.ORACLES | q_sql.ORACLES
ORACLES: dict[str, str] = {f"{name}_by_match": each_match(_ONE[name]) for name in _KEYED}
