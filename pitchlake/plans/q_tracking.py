"""Geometry, joins, matching, evaluation, tracking, teams, ball and sources as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources
from ..operators import ball, boxes, capacity, evaluation, filters, islands, matching, pitch, reduction, stretches, teams, tracking
from ..operators.lineage import folder
from .base import PAIRS, SPEEDS, ZONE, H, Query, R, over, sql

_P = pitch.Pitch()
#: Seconds of a match in one task.
_PIECE = 120.0
(_H0, _H1, _H2) = H


def _w(u: str, v: str) -> str:
    return f"({_H2[0]}*{u} + {_H2[1]}*{v} + {_H2[2]})"


def _px(u: str, v: str, row: list[float]) -> str:
    return f"(({row[0]}*{u} + {row[1]}*{v} + {row[2]}) / {_w(u, v)})".replace("+ -", "- ")


def _e(x: float) -> str:
    return f"cast({x!r} as double)"


def _sql_scales(u: str, v: str) -> str:
    """The smaller singular value of the Jacobian, by its entries."""
    n = f"({_e(_H2[0])}*{u} + {_e(_H2[1])}*{v} + {_e(_H2[2])})"
    p = f"({_e(_H0[0])}*{u} + {_e(_H0[1])}*{v} + {_e(_H0[2])})"
    q = f"({_e(_H1[0])}*{u} + {_e(_H1[1])}*{v} + {_e(_H1[2])})"
    j = [f"(({_e(row[k])}*{n} - {top}*{_e(_H2[k])}) / ({n}*{n}))" for row, top in ((_H0, p), (_H1, q)) for k in (0, 1)]
    s = "(" + " + ".join(f"{x}*{x}" for x in j) + ")"
    d = f"({j[0]}*{j[3]} - {j[1]}*{j[2]})"
    return f"sqrt(greatest(({s} - sqrt(greatest({s}*{s} - 4*{d}*{d}, 0))) / 2, 0))"


def _pred(p):
    return p.where("etiqueta <> 'staff'").select("frame", F.col("id_jugador").alias("obj_id"), "x_m", "y_m", F.col("etiqueta").alias("team"))


def _pairs(g, p):
    return matching.nearest(g, _pred(p), 2.0)


def _q(df, *cols, keep=()):
    return df.select(*keep, *(fn.rounded(F.col(c)).alias(c) for c in cols))


def _asof(b, p, tol):
    times = p.select("frame", "tiempo_s").distinct()
    return islands.nearest_in_time(b.select("frame", "cand_idx", "t"), times, tol, "t", "tiempo_s", ["frame"]).select("frame", "cand_idx", "r_frame")


def _tracklets(p):
    """Tracklets for link queries: an identity cut every 10 seconds' worth of frames."""
    obs = p.where("equipo < 2").select((F.col("id_jugador") * 1000 + F.floor(F.col("frame") / 250)).cast("int").alias("tracklet_id"), "frame", F.col("tiempo_s").alias("t"), "x_m", "y_m")
    return obs


_TRK = """, obs as (select cast(id_jugador * 1000 + floor(frame / 250) as int) as tracklet_id, frame, tiempo_s as t, x_m, y_m from positions where equipo < 2),
 trk as (select tracklet_id, min(t) as t0, max(t) as t1, arg_min(x_m, t) as x0, arg_min(y_m, t) as y0, arg_max(x_m, t) as x1, arg_max(y_m, t) as y1 from obs group by 1)"""


def _box_dets(d):
    return d.select("frame", F.col("det_idx").alias("box_idx"), "x1", "y1", "x2", "y2")


def _track(b, p):
    return ball.pick_nearest(b, p)


def _parts(d):
    a, b = d.where("frame < 700"), d.where("frame >= 600").withColumn("conf", F.col("conf") * 0.5)
    return sources.merge_caches([a, b])


def _violations(d):
    frames = d.select("frame").distinct().withColumn("seq", F.col("frame"))
    bad = d.withColumn("conf", F.when((F.col("frame") == 30) & (F.col("det_idx") == 1), 1.5).otherwise(F.col("conf"))).withColumn("x2", F.when(F.col("frame") == 60, F.col("x1")).otherwise(F.col("x2")))
    return sources.content_violations(bad, frames.where("frame not between 90 and 140"), 3)


def _clicks(spark):
    """Clicks on the pitch's named points through the homography of these queries; every ninth is far off."""
    back = pitch.inverse(H)
    at = lambda x, y: [(r[0] * x + r[1] * y + r[2]) / (back[2][0] * x + back[2][1] * y + back[2][2]) for r in back[:2]]
    rows = [(n, *(c + (90.0 if i % 9 == 4 else 0.0) for c in at(x, y)), x, y) for i, (n, (x, y)) in enumerate(sorted(_P.points().items()))]
    return spark.createDataFrame(rows, "name string, px double, py double, x_m double, y_m double")


def _cameras(g):
    """A camera for each minute of observations: a person's mean place there is a named point, clicked through the homography of these queries."""
    points = g.groupBy(F.floor(F.col("frame") / 1500).cast("int").alias("camera"), F.col("obj_id").cast("string").alias("name")).agg(F.avg("x_m").alias("x_m"), F.avg("y_m").alias("y_m"))
    px, py = fn.project(F.col("x_m"), F.col("y_m"), pitch.inverse(H))
    return points.select("camera", "name", px.alias("px"), py.alias("py"), "x_m", "y_m")


def _components(f):
    """The vectors along their 16 main components, and what that loses."""
    c = reduction.principal(f, "feat", 16)
    if c is None:
        return f.select("frame", "det_idx", F.lit(None).cast("array<double>").alias("low"), F.lit(None).cast("double").alias("error"))
    low = f.select("frame", "det_idx", "feat", reduction.projected(F.col("feat"), c).alias("low"))
    return low.select("frame", "det_idx", F.transform("low", lambda x: fn.rounded(x, 5)).alias("low"), fn.rounded(reduction.squared_error(F.col("feat"), F.col("low"), c), 5).alias("error"))


def _round_trip(g):
    """Observations as clicks, written as an annotation file and read back."""
    clicks = g.select("frame", "obj_id", (F.col("x_m") * 10).alias("px"), (F.col("y_m") * 10 + 50).alias("py"), F.when(F.col("label") == "referee", "referee").otherwise(F.col("team")).alias("team"))
    path = folder(g.sparkSession, "annotation")
    sources.write_cvat(sources.cvat_tracks(clicks), path)
    return sources.read_cvat(g.sparkSession, path).select("frame", "obj_id", "label", "team", "x1", "y1", "x2", "y2")


def _jumping(d):
    """Detections as tracklets that jump every 60 frame numbers, into a box twice as tall that moves as a whole."""
    own = F.floor(F.col("frame") / 60)
    tall = F.col("frame") % 60 < 6
    shift = (own % 2) * 5.0
    return d.select(F.col("det_idx").alias("tracklet_id"), "frame", "t", (F.col("det_idx") * 3 + 10.0 + shift).alias("x_m"), F.lit(20.0).alias("y_m"), (F.col("det_idx") * 20 + shift * 10).alias("x1"), (300 + shift * 10 - F.when(tall, 40).otherwise(0)).alias("y1"), (F.col("det_idx") * 20 + shift * 10 + 15).alias("x2"), (340 + shift * 10).alias("y2"))


def _errors(g, p):
    prox = evaluation.proximity(g, _pairs(g, p))
    return prox.select((F.col("neighbour_m") % 2).alias("position"), (1.0 - F.col("found")).alias("missing"), F.lit(0.25).alias("phantom"), (F.col("obj_id") % 3 * 0.5).alias("team"), (F.col("frame") % 2 * 0.5).alias("duplicate"))


def _features_labelled(f, n=None):
    return f.withColumn("feat", F.col("feat").cast("array<double>"))


_PROTO = teams.Prototypes([1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62, [0.0, 0.0, 1.0] + [0.0] * 61)
_DIST = lambda k: f"sqrt(list_sum(list_transform(feat, lambda x, i: (cast(x as double) - (case when i = {k + 1} then 1e0 else 0e0 end)) * (cast(x as double) - (case when i = {k + 1} then 1e0 else 0e0 end)))))"

def _halves(d):
    """The stretches of a table as matches of their own: 600 frames each."""
    return d.withColumn("match_no", F.floor(F.col("frame") / 600).cast("int"))


_PLACE_PROTO = teams.Prototypes([0.25, 0.4], [0.7, 0.4], [0.5, 0.9])


def _by_place(p):
    """Positions with their place as the vector of every row."""
    return p.withColumn("feat", F.array(F.col("x_m") / 100, F.col("y_m") / 64))


QUERIES: dict[str, Query] = {
    # geometry
    "homography_project": over("detections")(lambda d: d.select("frame", "det_idx", *(fn.rounded(c).alias(n) for c, n in zip(fn.project((F.col("x1") + F.col("x2")) / 2, F.col("y2"), H), ("px_m", "py_m"), strict=True)))),
    "implied_size": over("detections")(lambda d: d.select("frame", "det_idx", fn.rounded(fn.implied_size(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), H)[0], 5).alias("tall_m"))),
    "implied_size_filter": over("detections")(lambda d: filters.by_implied_size(d, H, 0.5, 1.5).select("frame", "det_idx")),
    "match_threshold": over("gt_obs")(lambda g: g.select("frame", "obj_id", fn.rounded(fn.match_threshold(F.col("y_m"))).alias("most_m"), fn.rounded(fn.position_sigma(F.col("y_m"))).alias("sigma"), fn.rounded(fn.geometry_weight(F.lit(0.12), F.col("y_m"))).alias("alpha"))),
    "mixed_cost": over("gt_obs")(lambda g: g.select("frame", "obj_id", fn.rounded(fn.mixed_cost(F.col("x_m") % 2, F.lit(0.12), F.col("y_m"), F.col("obj_id") % 5 / 5.0)).alias("cost")).where("cost < 10")),
    "signed_edge_distance": over("positions")(lambda p: p.select("frame", "id_jugador", fn.edge_distance(F.col("x_m"), F.col("y_m"), 100.0, 64.0).alias("edge_m"), fn.outside_distance(F.col("x_m"), F.col("y_m"), 100.0, 64.0).alias("out_m"))),
    "clamped": over("positions")(lambda p: p.select("frame", "id_jugador", fn.clamp(F.col("x_m"), 20.0, 80.0).alias("x_m"), fn.depth_value(F.col("x_m"), F.col("y_m"), "y", False, 64.0).alias("depth_m"))),
    "polygon_mask": over("positions")(lambda p: filters.in_zone(p, ZONE, "x_m", "y_m").select("frame", "id_jugador")),
    "wilson_lower": over("positions")(lambda p: p.groupBy("id_jugador").agg(F.count(F.when(F.col("x_m") < 40, 1)).alias("hits"), F.count("*").alias("n")).select("id_jugador", fn.rounded(fn.wilson_lower(F.col("hits"), F.col("n"))).alias("low"))),
    "cosine_pairs": over("features")(lambda f: f.alias("a").join(f.alias("b"), (F.col("a.frame") == F.col("b.frame")) & (F.col("a.det_idx") < F.col("b.det_idx"))).select(F.col("a.frame").alias("frame"), F.col("a.det_idx").alias("a"), F.col("b.det_idx").alias("b"), fn.rounded(fn.cosine_distance(F.col("a.feat"), F.col("b.feat")), 5).alias("away"))),
    "unit_vectors": over("features")(lambda f: f.select("frame", "det_idx", fn.rounded(fn.norm(fn.unit(F.col("feat"))), 5).alias("size"), fn.dominant_bin(F.col("feat"), 8)[0].alias("row"), fn.dominant_bin(F.col("feat"), 8)[1].alias("col"))),
    "max_iou": over("detections")(lambda d: _q(filters.max_overlap(d), "max_iou", keep=("frame", "det_idx"))),
    "occluded_detections": over("detections")(lambda d: filters.occluded(d).select("frame", "det_idx")),
    "resolution_lookup": over("positions")(lambda p: pitch.with_resolution(p, pitch.resolution_grid(p.sparkSession, H, _P), _P).groupBy("id_jugador").agg(F.count("*").alias("n"), fn.rounded(F.avg("factor"), 4).alias("factor"))),
    "scale_audit": over("positions")(lambda p: pitch.scale_audit(pitch.points_table(p.sparkSession, _P).withColumn("x_m", F.col("x_m") + 0.5), p.sparkSession, _P)),
    "homography_fit": over("positions")(lambda p: _q(pitch.fit_homography(_clicks(p.sparkSession)), "error_m", keep=("inliers", "clicks"))),
    "homography_stability": over("gt_obs")(lambda g: _q(pitch.click_stability(_cameras(g), [(x, y) for x in (10.0, 50.0, 90.0) for y in (5.0, 32.0, 59.0)], key=["camera"]), "moved_m", keep=("camera", "x_m", "y_m", "fits"))),
    "edge_clicks": over("detections")(lambda d: pitch.edge_clicks(d.select("frame", "det_idx", ((F.col("x1") + F.col("x2")) / 2).alias("px"), F.col("y2").alias("py")), 350, 540).select("frame", "det_idx")),
    "image_band": over("positions")(lambda p: pitch.image_band(p.sparkSession, H, 80.0, 100.0, 0.0, 64.0)),
    "visible_field": over("positions")(lambda p: pitch.visible_field(p.sparkSession, H, 1920, 1080, _P)),
    "input_checks": over("detections")(lambda d: pitch.input_checks(d, 400, 500)),
    "corrected_clicks": over("detections")(lambda d: pitch.corrected_clicks(d.select("frame", F.col("det_idx").alias("obj_id"), (F.col("x1") + 5).alias("px"), (F.col("y2") + 3).alias("py")), d).select("frame", "obj_id", fn.rounded(F.col("py")).alias("py"))),
    # filters
    "confidence_filter_reindex": over("detections")(lambda d: filters.by_confidence(d, 0.4, True).select("frame", "det_idx", "new_idx")),
    "box_filter": over("detections")(lambda d: filters.by_box(d, 0.3, 0.0004, 1920, 1080).select("frame", "det_idx")),
    "on_pitch": over("positions")(lambda p: filters.on_pitch(p, 100.0, 64.0).select("frame", "id_jugador")),
    "export_margin": over("positions")(lambda p: filters.on_pitch(p, 100.0, 64.0, 6.0).select("frame", "id_jugador")),
    "staff_ball_filter": over("ball_cand", "positions")(lambda b, p: filters.without_staff_balls(b.withColumn("my", F.when(F.col("cand_idx") == 1, -6.0).otherwise(F.col("my"))).withColumn("mx", F.when(F.col("cand_idx") == 1, 50.0).otherwise(F.col("mx"))), p, 100.0, 64.0).select("frame", "cand_idx")),
    "hard_cut_frames": over("ball_cand")(lambda b: filters.hard_cut(b.withColumn("mx", F.col("mx") + 20), 100.0, 64.0, -30.0)[1]),
    "long_enough": over("positions")(lambda p: filters.long_enough(p, "id_jugador", 355).select("frame", "id_jugador")),
    "frame_range": over("detections")(lambda d: filters.frame_range(d, 25.0, 0.2, 10.0).select("frame", "det_idx")),
    # joins
    "nearest_other": over("positions")(lambda p: _q(islands.nearest_other(p), "nearest_m", keep=("frame", "id_jugador"))),
    "nearest_team_mate": over("positions")(lambda p: _q(islands.nearest_other(p, F.col("equipo") == F.col("o_equipo")), "nearest_m", keep=("frame", "id_jugador"))),
    "asof_ball_player": over("ball_cand", "positions")(lambda b, p: _asof(b, p, 0.08)),
    "asof_wide": over("ball_cand", "positions")(lambda b, p: _asof(b, p, 0.2)),
    "identity_pair_overlap": over("positions")(lambda p: _q(islands.pair_overlap(p, 100), "median_m", keep=("id_a", "id_b", "shared"))),
    "range_join_candidates": over("positions")(lambda p: islands.range_candidates(tracking.summaries(_tracklets(p)), 6.0).select(F.col("a_tracklet_id").alias("a"), F.col("b_tracklet_id").alias("b"), fn.rounded(F.col("gap")).alias("gap"))),
    "plausible_links": over("positions")(lambda p: tracking.plausible_links(tracking.summaries(_tracklets(p))).select("a", "b", fn.rounded(F.col("away")).alias("away"))),
    "unique_links": over("positions")(lambda p: tracking.unique_links(tracking.plausible_links(tracking.summaries(_tracklets(p)))).select("a", "b")),
    "link_funnel": over("positions")(lambda p: tracking.link_funnel(tracking.summaries(_tracklets(p)))),
    "same_box": over("detections")(lambda d: matching.same_box(d, d.where("conf > 0.5"))),
    "unmatched_rows": over("gt_obs", "positions")(lambda g, p: matching.unmatched(_pred(p), g, 1.0).select("frame", "obj_id")),
    "nearest_gt_row": over("gt_obs", "positions")(lambda g, p: _q(_pairs(g, p), "distance", keep=("frame", "gt_id", "pred_id"))),
    "optimal_match_after": over("gt_obs", "positions")(lambda g, p: matching.optimal_then_threshold(g, _pred(p))),
    "optimal_match_before": over("gt_obs", "positions")(lambda g, p: matching.threshold_then_optimal(g, _pred(p))),
    "greedy_match": over("gt_obs", "positions")(lambda g, p: _q(matching.greedy_in_order(g, _pred(p)), "distance", keep=("frame", "gt_id", "pred_id"))),
    "box_hits": over("detections")(lambda d: matching.box_hits(d.select("frame", F.col("det_idx").alias("obj_id"), (F.col("x1") + 3).alias("px"), (F.col("y1") + 3).alias("py")), d)),
    "alignment_sanity": over("gt_obs", "detections")(matching.mean_alignment),
    # evaluation
    "common_frames": over("gt_obs", "positions")(evaluation.shared_frames),
    "idf1_idsw": over("gt_obs", "positions")(lambda g, p: evaluation.identity_scores(g, _pred(p), _pairs(g, p))),
    "id_switches": over("gt_obs", "positions")(lambda g, p: evaluation.switches(g, _pairs(g, p))),
    "fragmentation": over("gt_obs", "positions")(lambda g, p: evaluation.fragmentation(_pairs(g, p))),
    "team_accuracy": over("gt_obs", "positions")(lambda g, p: evaluation.team_accuracy(g, _pred(p), _pairs(g, p))),
    "coverage_swap": over("gt_obs", "positions")(lambda g, p: evaluation.collective_coverage(g, _pred(p), _pairs(g, p))),
    "team_confusion": over("gt_obs", "positions")(lambda g, p: evaluation.team_summary(g, _pred(p), _pairs(g, p))),
    "concurrency": over("gt_obs", "positions")(lambda g, p: evaluation.concurrency(g, _pred(p), evaluation.shared_frames(g, p))),
    "impossible_transitions": over("positions")(lambda p: evaluation.impossible_runs(p, 2.0, 0.3)),
    "error_ladder": over("gt_obs", "positions")(lambda g, p: evaluation.error_ladder(_errors(g, p)).select("subset", fn.rounded(F.col("error")).alias("error"), "n")),
    "shapley_ladder": over("gt_obs", "positions")(lambda g, p: evaluation.shapley(evaluation.error_ladder(_errors(g, p)))),
    "count_identity": over("gt_obs", "positions")(lambda g, p: evaluation.count_identity(g, _pred(p), _pairs(g, p))),
    "localisation_by_band": over("gt_obs", "positions")(lambda g, p: evaluation.localisation(_pairs(g, p), g)),
    "team_crossings": over("gt_obs", "positions")(lambda g, p: evaluation.team_crossings(_pairs(g, p), g)),
    "identity_purity": over("gt_obs", "positions")(lambda g, p: evaluation.purity(_pairs(g, p))),
    "row_classes": over("gt_obs", "positions")(lambda g, p: evaluation.classify_rows(_pred(p), g, matching.nearest(g, _pred(p), 0.4)).groupBy("kind").agg(F.count("*").alias("n"))),
    "first_lost": over("gt_obs", "positions")(lambda g, p: evaluation.first_lost([("found", _pairs(g, p).select("frame", F.col("gt_id").alias("obj_id"))), ("near", _pairs(g, p).where("distance < 0.4").select("frame", F.col("gt_id").alias("obj_id")))], g).groupBy("lost_at").agg(F.count("*").alias("n"))),
    "proximity": over("gt_obs", "positions")(lambda g, p: evaluation.proximity(g, _pairs(g, p))),
    "hota": over("gt_obs", "positions")(lambda g, p: evaluation.hota(g, _pred(p).join(g.select("frame").distinct(), "frame", "left_semi"))),
    "clear_mot": over("gt_obs", "positions")(lambda g, p: evaluation.clear_mot(g, _pred(p).join(g.select("frame").distinct(), "frame", "left_semi"))),
    # tracking
    "conservative_tracker_stretches": over("detections")(lambda d: stretches.tracked_in_stretches(d, lambda rows, by: tracking.conservative_tracker(rows, 0.12, key=by), 40.0, 10.0)[0].select("identity_id", "frame", "det_idx")),
    "conservative_tracker": over("detections")(lambda d: tracking.conservative_tracker(d, 0.12, seconds=_PIECE)),
    "appearance_tracker": over("detections", "features")(lambda d, f: tracking.appearance_tracker(d.join(f.select("frame", "det_idx", F.col("feat").alias("emb")), ["frame", "det_idx"], "left"), seconds=_PIECE)),
    "box_tracker": over("detections")(lambda d: tracking.box_tracker(d, seconds=_PIECE)),
    "box_tracker_matches": over("detections")(lambda d: tracking.box_tracker(_halves(d), key="match_no")),
    "box_tracker_look": over("detections", "features")(lambda d, f: tracking.box_tracker(d.join(f.select("frame", "det_idx", "feat"), ["frame", "det_idx"], "left"), vector="feat", look=boxes.Look(1.4), seconds=_PIECE)),
    "stitch_greedy": over("positions")(lambda p: _q(tracking.choose_links(tracking.stitch_candidates(tracking.summaries(_tracklets(p)))), "cost", keep=("a", "b"))),
    "stitch_global": over("positions")(lambda p: tracking.choose_links(tracking.stitch_candidates(tracking.summaries(_tracklets(p))), "global")),
    "purity_stitch_pass": over("positions")(lambda p: _q(tracking.mutual_best(tracking.stitch_candidates(tracking.summaries(_tracklets(p)), v_max=8.0)), "cost", keep=("a", "b"))),
    "purity_stitch": over("positions")(lambda p: tracking.purity_stitch(_tracklets(p)).groupBy("identity_id").agg(F.count("*").alias("n"))),
    "identities": over("positions")(lambda p: tracking.components(_tracklets(p).select("tracklet_id").distinct(), tracking.unique_links(tracking.plausible_links(tracking.summaries(_tracklets(p)))))),
    "duplicate_pairs": over("positions")(lambda p: tracking.duplicates(p, 3, 6.0)),
    "duplicate_merge": over("positions")(lambda p: tracking.merge_identities(p, tracking.duplicates(p, 3, 4.0)).groupBy("id_jugador").agg(F.count("*").alias("n"))),
    "roster_cap": over("positions")(lambda p: tracking.roster_cap(p, p, 23, 6.0).groupBy("id_jugador").agg(F.count("*").alias("n"))),
    "colour_cuts": over("positions")(lambda p: tracking.colour_cuts(p.withColumn("equipo", F.when((F.col("id_jugador") < 6) & (F.col("frame") > 600), 1).otherwise(F.col("equipo"))))),
    "fused_boxes": over("detections")(lambda d: tracking.fused_boxes(d.withColumn("tracklet_id", F.col("det_idx")).withColumnsRenamed({"mx": "x_m", "my": "y_m"}), 1.0, 1.1).select("tracklet_id", "frame")),
    "fused_cuts": over("detections")(lambda d: tracking.fused_cuts(_jumping(d), 1.0)),
    "pruned_embeddings": over("detections", "features")(lambda d, f: tracking.pruned_embeddings(d.select(F.col("det_idx").alias("tracklet_id"), "frame"), f.select(F.col("det_idx").alias("tracklet_id"), "frame", "det_idx"), 3, 6)),
    "embedding_components": over("features")(_components),
    "crossing_frames": over("detections")(tracking.crossings),
    "reentry_gate": over("features")(lambda f: tracking.reentry_gate(f.select((F.col("det_idx") % 4).alias("tracklet_id"), (F.col("frame") * 10 + F.col("det_idx")).alias("frame"), F.col("feat").alias("emb")), 8, 0.1)),
    "appearance_cuts": over("features")(lambda f: tracking.appearance_cuts(f.select((F.col("det_idx") % 4).cast("int").alias("tracklet_id"), (F.col("frame") * 10 + F.col("det_idx")).cast("int").alias("frame"), F.col("feat").alias("emb")), 6, 0.3)),
    # teams
    "prototype_predict": over("features")(lambda f: teams.predict(_features_labelled(f), _PROTO).select("frame", "det_idx", "team", fn.rounded(F.col("away"), 5).alias("away"))),
    "team_fit": over("features")(lambda f: f.sparkSession.createDataFrame([(n, v) for n, v in (("A", teams.fit_prototypes(f).a), ("B", teams.fit_prototypes(f).b))], "team string, prototype array<double>")),
    "identity_colours": over("features")(lambda f: teams.identity_colours(f.select(F.col("det_idx").alias("id_jugador"), (F.col("frame") % 2 == 0).alias("near"), (F.col("label") > 3).alias("free"), "feat")).select("id_jugador", "crops", fn.rounded(fn.norm(F.col("feat")), 5).alias("size"))),
    "identity_teams": over("features")(lambda f: teams.classify_identities(f.select(F.col("det_idx").alias("id_jugador"), F.lit(True).alias("near"), F.lit(True).alias("free"), F.col("feat").cast("array<double>").alias("feat")), _PROTO)),
    "observation_teams": over("features")(lambda f: teams.label_observations(f.select(F.col("det_idx").alias("id_jugador"), "frame", "feat"), _PROTO, 6)),
    "goalkeeper_area": over("positions")(lambda p: teams.keepers_by_area(p.withColumn("y_m", F.when(F.col("etiqueta").startswith("portero"), 30.0 + F.col("y_m") % 4).otherwise(F.col("y_m"))))),
    "defended_sides": over("positions")(teams.defended_sides),
    "last_man": over("positions")(teams.last_men),
    "keeper_set": over("positions")(lambda p: teams.keeper_set(teams.last_men(p), p)),
    "staff_rule": over("positions")(teams.staff),
    "one_referee": over("positions")(teams.one_referee),
    "capped_labels": over("positions")(lambda p: teams.capped_labels(p.select("frame", "id_jugador", F.when(F.col("equipo") == 0, "A").when(F.col("equipo") == 1, "B").otherwise("otro").alias("team"), (F.col("x_m") / 100).alias("score")), 9)),
    "capped_identities": over("positions")(lambda p: capacity.label_rows(_by_place(p), _PLACE_PROTO, 9, 2, 0.3, None).select("id_jugador", "unit", "label").distinct()),
    "capped_chunks": over("positions")(lambda p: capacity.label_rows(_by_place(p), _PLACE_PROTO, 9, 2, 0.3, 1.5).select("id_jugador", "unit", "label").distinct()),
    "emission_model": over("positions")(lambda p: teams.fit_emissions(p.withColumn("ref", F.col("etiqueta") == "otro"), "y_m", "ref", [-10.0, 10.0, 20.0, 30.0, 40.0, 64.0])),
    "referee_path_segments": over("detections")(lambda d: teams.referee_path(d.select("frame", "t", "det_idx", "mx", "my", F.when(F.col("det_idx") == 11, 1.0).otherwise(-1.0).alias("log_lr")), seconds=30.0)),
    "referee_path": over("detections")(lambda d: teams.referee_path(d.select("frame", "t", "det_idx", "mx", "my", F.when(F.col("det_idx") == 11, 1.0).otherwise(-1.0).alias("log_lr")), seconds=_PIECE)),
    # ball
    "ball_plausible": over("ball_cand")(lambda b: ball.plausible(b.withColumn("mx", F.col("mx") * 1.5), 100.0, 64.0).select("frame", "cand_idx")),
    "static_marks": over("ball_cand")(lambda b: ball.static_marks(b, least=50, least_span_s=10.0).select("cx", "cy")),
    "without_marks": over("ball_cand")(lambda b: ball.without_marks(b, ball.static_marks(b, least=50, least_span_s=10.0)).select("frame", "cand_idx")),
    "ball_nearest_pick": over("ball_cand", "positions")(lambda b, p: ball.pick_nearest(b, p).select("frame", "cand_idx")),
    "ball_objects": over("ball_cand")(lambda b: ball.group_objects(b).groupBy("object").agg(F.count("*").alias("n"))),
    "parked_balls": over("ball_cand", "positions")(lambda b, p: ball.without_parked(ball.group_objects(b), p).select("frame", "cand_idx")),
    "ball_viterbi_segments": over("ball_cand")(lambda b: ball.best_path(b, seconds=20.0).select("frame", "cand_idx")),
    "ball_viterbi": over("ball_cand")(lambda b: ball.best_path(b, seconds=_PIECE).select("frame", "cand_idx")),
    "ball_segments": over("ball_cand", "positions")(lambda b, p: ball.continuity_segments(_track(b, p)).select("frame", "segment")),
    "aerial_phases": over("ball_cand")(lambda b: ball.aerial(b.where("cand_idx = 0"), 20.0, 1.6, 0.0, 40.0).select("frame", "aerial")),
    "contacts_angle": over("ball_cand", "positions")(lambda b, p: ball.contacts_by_angle(b.where("cand_idx = 0"), p, 70.0, 1.0, 6.0, 0).select("frame", "id_jugador", fn.rounded(F.col("angle"), 5).alias("angle"))),
    "acceleration_peaks": over("ball_cand")(lambda b: _q(ball.acceleration_peaks(b.where("cand_idx = 0")), "change", keep=("frame", "t", "mx", "my"))),
    "merged_contacts": over("ball_cand", "positions")(lambda b, p: ball.merge_contacts(ball.contacts_by_angle(b.where("cand_idx = 0"), p, 70.0, 1.0), ball.acceleration_peaks(b.where("cand_idx = 0")))),
    "flight_lines": over("ball_cand")(lambda b: _q(ball.flight_lines(ball.aerial(b.where("cand_idx = 0"))), "fx", "fy", keep=("frame", "es_real"))),
    "ball_fill": over("ball_cand")(lambda b: _q(ball.fill(b.where("cand_idx = 0 and frame % 10 < 6"), b), "mx", "my", keep=("frame", "how"))),
    "ball_quality": over("ball_cand")(lambda b: b.select("frame", "cand_idx", ball.quality(F.col("mx") > 60, F.col("h_px") > 11, F.col("conf") > 0.5).alias("quality"))),
    "possession": over("ball_cand", "positions")(lambda b, p: ball.possession(b.where("cand_idx = 0"), p, 6.0).select("frame", "id_jugador", "equipo")),
    "possession_zone_corrected": over("ball_cand", "positions")(lambda b, p: ball.possession_share(ball.possession(b.where("cand_idx = 0"), p, 6.0), b.where("cand_idx = 0"))),
    "possession_changes": over("ball_cand", "positions")(lambda b, p: ball.possession_changes(ball.possession(b.where("cand_idx = 0"), p, 6.0)).select("frame", "before", "after")),
    "ball_gaps": over("ball_cand")(lambda b: ball.ball_gaps(b.where("cand_idx = 0 and frame % 100 < 60"), 1.0, 8.0, 20.0).select("frame", fn.rounded(F.col("gap_s")).alias("gap_s"))),
    "combined_table": over("positions", "ball_cand")(lambda p, b: ball.combined(p, b.where("cand_idx = 0")).select("frame", "tiempo_s", "id_jugador", "equipo", "etiqueta", "x_m", "y_m", "es_real")),
    "anchored_ball": over("ball_cand")(lambda b: ball.anchored(b.where("cand_idx = 1"))),
    "mark_share": over("ball_cand")(lambda b: ball.mark_share(b, ball.static_marks(b, least=50, least_span_s=10.0))),
    "merged_boxes": over("detections")(lambda d: ball.merge_boxes(_box_dets(d).where("box_idx < 10"), _box_dets(d).where("box_idx >= 8")).select("frame", "box_idx", "tile")),
    # sources
    "cache_validation": over("detections")(_violations),
    "coverage_holes": over("detections")(lambda d: islands.coverage_holes(d.where("frame % 90 < 75"), 3)),
    "merge_partial_caches": over("detections")(lambda d: _parts(d).groupBy((F.col("frame") < 700).alias("first")).agg(F.count("*").alias("n"), fn.rounded(F.sum("conf")).alias("conf"))),
    "cache_round_trip": over("detections")(lambda d: sources.flatten(sources.nest(d)).select("frame", "det_idx", "mx", "conf")),
    "mot_export": over("gt_obs")(lambda g: _q(sources.mot_rows(g), "left", "top", keep=("frame", "id", "width"))),
    "cvat_round_trip": over("gt_obs")(_round_trip),
    "plan_segments": over("positions")(lambda p: sources.segments(p.sparkSession, 5400.0, 600.0, 30.0)),
    "resume_frames": over("detections")(lambda d: sources.left_to_do(d.select("frame").distinct(), d.where("frame < 600"), "s", "s")),
    "metrics_json": over("positions")(lambda p: sources.metrics_json(p.groupBy("equipo").agg(F.count("*").alias("n")))),
    "same_settings": over("positions")(lambda p: sources.same_metadata(p.sparkSession.createDataFrame([(25.0, 3, 1920, 1080), (25.0, 3, 1920, 1080), (30.0, 3, 1920, 1080)], "fps double, sample int, width int, height int"))),
}

_EDGE = "greatest(-x_m, x_m - 100e0, -y_m, y_m - 64e0)"
_IOU = """, o as (select a.frame, a.det_idx, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as inter, (a.x2-a.x1)*(a.y2-a.y1) as aa, (b.x2-b.x1)*(b.y2-b.y1) as bb
  from detections a left join detections b on a.frame = b.frame and a.det_idx <> b.det_idx), m as (select frame, det_idx, coalesce(max(case when aa + bb - inter > 0 then inter / (aa + bb - inter) else 0 end), 0) as max_iou from o group by 1, 2)"""
_ASOF = lambda tol: sql("ball_cand positions", f", t as (select distinct frame as tf, tiempo_s from positions), c as (select b.frame, b.cand_idx, tf, row_number() over (partition by b.frame, b.cand_idx order by abs(t - tiempo_s), tiempo_s) as r from ball_cand b left join t on abs(t - tiempo_s) <= {tol}) select frame, cand_idx, tf as r_frame from c where r = 1")
_GROUP = "case when {0} in ('A','portero_A') then 'A' when {0} in ('B','portero_B') then 'B' end"
_SW = "case when {0} = 'A' then 'B' when {0} = 'B' then 'A' else {0} end"
_OWN = """, near as (select b.frame, b.t, tf, row_number() over (partition by b.frame order by abs(t - tiempo_s), tiempo_s) as r, b.mx, b.my from ball_cand b join (select distinct frame as tf, tiempo_s from positions) s on abs(t - tiempo_s) <= 0.2e0 where b.cand_idx = 0),
 own as (select * from (select n.frame, n.t, n.mx, p.id_jugador, p.equipo, row_number() over (partition by n.frame order by sqrt((n.mx-p.x_m)*(n.mx-p.x_m)+(n.my-p.y_m)*(n.my-p.y_m)), p.id_jugador) as k from near n join positions p on p.frame = n.tf where n.r = 1 and p.equipo in (0,1) and sqrt((n.mx-p.x_m)*(n.mx-p.x_m)+(n.my-p.y_m)*(n.my-p.y_m)) <= 6e0) where k = 1)"""
_MARKS = ", cells as (select cast(floor(px/12) as int) as cx, cast(floor(py/12) as int) as cy from ball_cand group by 1, 2 having count(*) >= 50 and max(t) - min(t) >= 10e0 and greatest(stddev_pop(px), stddev_pop(py)) <= 4e0 and count(distinct floor(t/60)) >= 0.5e0 * (select count(distinct floor(t/60)) from ball_cand))"
_PICK = ", pk as (select * from (select b.*, row_number() over (partition by b.frame order by d nulls last, conf desc, cand_idx) as r from (select b.frame, b.t, b.cand_idx, b.px, b.py, b.conf, min(sqrt((mx-x_m)*(mx-x_m)+(my-y_m)*(my-y_m))) as d from ball_cand b left join positions p on p.frame = b.frame group by all) b) where r = 1)"

ORACLES: dict[str, str] = {
    "homography_project": sql("detections", f"select frame, det_idx, {R(_px('((x1+x2)/2)', 'y2', _H0))} as px_m, {R(_px('((x1+x2)/2)', 'y2', _H1))} as py_m from detections"),
    "implied_size": sql("detections", f"select frame, det_idx, {R('(y2 - y1) * ' + _sql_scales('((x1+x2)/2)', 'y2'), 5)} as tall_m from detections"),
    "implied_size_filter": sql("detections", f", s as (select frame, det_idx, (y2 - y1) * {_sql_scales('((x1+x2)/2)', 'y2')} as h from detections) select frame, det_idx from s where h between 0.5e0 * (select median(h) from s where h > 0) and 1.5e0 * (select median(h) from s where h > 0)"),
    "match_threshold": sql("gt_obs", f", s as (select *, least(greatest(0.11e0 + 0.026e0*y_m, 0.11e0), 1.85e0) as sg from gt_obs) select frame, obj_id, {R('least(greatest(0.4e0 + 0.045e0*y_m, 1e0), 4e0)')} as most_m, {R('sg')} as sigma, {R('(1/(sg*sg + 0.18e0*0.18e0)) / (1/(sg*sg + 0.18e0*0.18e0) + 1)')} as alpha from s"),
    "mixed_cost": sql("gt_obs", f", s as (select *, least(greatest(0.11e0 + 0.026e0*y_m, 0.11e0), 1.85e0) as sg, x_m % 2 as d, (obj_id % 5) / 5e0 as app from gt_obs), c as (select *, 7*0.12e0 + 2*sg as rad, (1/(sg*sg + 0.18e0*0.18e0)) / (1/(sg*sg + 0.18e0*0.18e0) + 1) as al from s) select frame, obj_id, {R('al * d / rad + (1 - al) * least(1, app)')} as cost from c where d <= rad"),
    "signed_edge_distance": sql("positions", f"select frame, id_jugador, {_EDGE} as edge_m, greatest({_EDGE}, 0) as out_m from positions"),
    "clamped": sql("positions", "select frame, id_jugador, least(greatest(x_m, 20e0), 80e0) as x_m, 64e0 - y_m as depth_m from positions"),
    "polygon_mask": sql("positions", "select frame, id_jugador from positions where (" + " + ".join(f"case when (({_e(y0)} > y_m) <> ({_e(y1)} > y_m)) and x_m < ({_e(x1)} - {_e(x0)}) * (y_m - {_e(y0)}) / ({_e(y1)} - {_e(y0)}) + {_e(x0)} then 1 else 0 end" for (x0, y0), (x1, y1) in zip(ZONE, [*ZONE[1:], ZONE[0]], strict=True)) + ") % 2 = 1"),
    "wilson_lower": sql("positions", f", c as (select id_jugador, count(case when x_m < 40 then 1 end) * 1e0 as k, count(*) as n from positions group by 1), p as (select *, k / n as p from c) select id_jugador, {R('greatest((p + 1.96e0*1.96e0/(2*n) - 1.96e0 * sqrt((p*(1-p) + 1.96e0*1.96e0/(4*n))/n)) / (1 + 1.96e0*1.96e0/n), 0)')} as low from p"),
    "cosine_pairs": sql("features", f", d as (select frame, det_idx, list_transform(feat, lambda x: cast(x as double)) as v from features) select a.frame, a.det_idx as a, b.det_idx as b, {R('1 - list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(b.v, b.v)) + 1e-9))', 5)} as away from d a join d b on a.frame = b.frame and a.det_idx < b.det_idx"),
    "unit_vectors": sql("features", "select frame, det_idx, 1e0 as size, cast((list_position(feat, list_max(feat)) - 1) // 8 as int) as row, cast((list_position(feat, list_max(feat)) - 1) % 8 as int) as col from features"),
    "max_iou": sql("detections", _IOU + f" select frame, det_idx, {R('max_iou')} as max_iou from m"),
    "occluded_detections": sql("detections", _IOU + " select frame, det_idx from m where max_iou > 0.10e0"),
    "input_checks": sql("detections", f", s as (select median(y2 - y1) as median_px, {R('avg(case when x1 <= 2 or y1 <= 2 or x2 >= 398 or y2 >= 498 then 1 else 0 end)')} as cut from detections) select *, median_px < 25 as small, cut >= 0.5e0 as cropped from s"),
    "corrected_clicks": sql("detections", f", c as (select frame, det_idx as obj_id, x1 + 5 as px, y2 + 3 as py from detections), n as (select c.*, arg_min(d.y2 - d.y1, sqrt((px - (d.x1+d.x2)/2)*(px - (d.x1+d.x2)/2) + (py - d.y2)*(py - d.y2))) as h from c left join detections d on c.frame = d.frame and sqrt((px - (d.x1+d.x2)/2)*(px - (d.x1+d.x2)/2) + (py - d.y2)*(py - d.y2)) <= 40 group by all) select frame, obj_id, {R('py + 0.129e0 * coalesce(h, (select median(y2 - y1) from detections))')} as py from n"),
    "confidence_filter_reindex": sql("detections", "select frame, det_idx, cast(row_number() over (partition by frame order by det_idx) - 1 as int) as new_idx from detections where conf >= 0.4e0"),
    "box_filter": sql("detections", "select frame, det_idx from detections where conf >= 0.3e0 and (x2-x1)*(y2-y1) <= 0.0004e0*1920*1080"),
    "on_pitch": sql("positions", "select frame, id_jugador from positions where x_m between 0 and 100 and y_m between 0 and 64"),
    "export_margin": sql("positions", "select frame, id_jugador from positions where x_m between -6 and 106 and y_m between -6 and 70"),
    "staff_ball_filter": sql("ball_cand positions", ", b as (select frame, cand_idx, case when cand_idx = 1 then 50e0 else mx end as mx, case when cand_idx = 1 then -6e0 else my end as my from ball_cand), n as (select b.frame, b.cand_idx, b.mx, b.my, coalesce(min(case when etiqueta = 'staff' then sqrt((mx-x_m)*(mx-x_m)+(my-y_m)*(my-y_m)) end), 'inf'::double) as s, coalesce(min(case when etiqueta <> 'staff' then sqrt((mx-x_m)*(mx-x_m)+(my-y_m)*(my-y_m)) end), 'inf'::double) as p, count(etiqueta) as k from b left join positions q on q.frame = b.frame group by 1, 2, 3, 4) select frame, cand_idx from n where not (k > 0 and greatest(-mx, mx-100, -my, my-64) > 0 and s < p and p > 3)"),
    "hard_cut_frames": sql("ball_cand", "select distinct frame from ball_cand where greatest(-(mx+20), mx+20-100, -my, my-64) > -30"),
    "long_enough": sql("positions", "select frame, id_jugador from positions where id_jugador in (select id_jugador from positions group by 1 having count(*) >= 355)"),
    "frame_range": sql("detections", "select frame, det_idx from detections where frame >= 300 and frame < 550"),
    "nearest_other": sql("positions", f"select a.frame, a.id_jugador, {R('min(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m)))')} as nearest_m from positions a left join positions b on a.frame = b.frame and a.id_jugador <> b.id_jugador group by 1, 2"),
    "nearest_team_mate": sql("positions", f"select a.frame, a.id_jugador, {R('min(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m)))')} as nearest_m from positions a left join positions b on a.frame = b.frame and a.id_jugador <> b.id_jugador and a.equipo = b.equipo group by 1, 2"),
    "asof_ball_player": _ASOF("0.08e0"),
    "asof_wide": _ASOF("0.2e0"),
    "identity_pair_overlap": sql("positions", f"select a.id_jugador as id_a, b.id_jugador as id_b, count(*) as shared, {R('median(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m)))')} as median_m from positions a join positions b on a.frame = b.frame and a.id_jugador < b.id_jugador group by 1, 2 having count(*) >= 100"),
    "range_join_candidates": sql("positions", _TRK + f" select a.tracklet_id as a, b.tracklet_id as b, {R('b.t0 - a.t1')} as gap from trk a join trk b on b.t0 > a.t1 and b.t0 <= a.t1 + 6 and a.tracklet_id <> b.tracklet_id"),
    "plausible_links": sql("positions", _TRK + f", l as (select a.tracklet_id as a, b.tracklet_id as b, b.t0 - a.t1 as gap, sqrt((b.x0-a.x1)*(b.x0-a.x1)+(b.y0-a.y1)*(b.y0-a.y1)) as away, b.y0 as by0 from trk a join trk b on b.t0 > a.t1 and b.t0 <= a.t1 + 3 and a.tracklet_id <> b.tracklet_id) select a, b, {R('away')} as away from l where away <= 7*gap + 2*least(greatest(0.11e0+0.026e0*by0, 0.11e0), 1.85e0)"),
    "unique_links": sql("positions", _TRK + ", l as (select a.tracklet_id as a, b.tracklet_id as b from trk a join trk b on b.t0 > a.t1 and b.t0 <= a.t1 + 3 and a.tracklet_id <> b.tracklet_id where sqrt((b.x0-a.x1)*(b.x0-a.x1)+(b.y0-a.y1)*(b.y0-a.y1)) <= 7*(b.t0-a.t1) + 2*least(greatest(0.11e0+0.026e0*b.y0, 0.11e0), 1.85e0)) select a, b from (select *, count(*) over (partition by a) as x, count(*) over (partition by b) as y from l) where x = 1 and y = 1"),
    "link_funnel": sql("positions", _TRK + ", l as (select b.t0 - a.t1 as gap, sqrt((b.x0-a.x1)*(b.x0-a.x1)+(b.y0-a.y1)*(b.y0-a.y1)) / (b.t0 - a.t1) as v from trk a join trk b on b.t0 > a.t1 and b.t0 <= a.t1 + 6 and a.tracklet_id <> b.tracklet_id) select count(*) as in_time, count(case when v <= 8 then 1 end) as in_speed, count(case when v <= 8 and gap <= 3 then 1 end) as soon from l"),
    "same_box": sql("detections", "select a.frame, a.det_idx as a_idx, b.det_idx as b_idx from detections a join detections b using (frame, x1, y1, x2, y2) where b.conf > 0.5e0"),
    "unmatched_rows": sql("gt_obs positions", PAIRS + " select frame, obj_id from pred p where not exists (select 1 from gt_obs g where g.frame = p.frame and sqrt((g.x_m-p.x_m)*(g.x_m-p.x_m)+(g.y_m-p.y_m)*(g.y_m-p.y_m)) <= 1)"),
    "nearest_gt_row": sql("gt_obs positions", PAIRS + f" select frame, gt_id, pred_id, {R('distance')} as distance from pairs"),
    "box_hits": sql("detections", ", c as (select frame, det_idx as obj_id, x1 + 3 as px, y1 + 3 as py from detections) select c.frame, c.obj_id, count(*) as boxes from c join detections d on c.frame = d.frame and ((px between d.x1 and d.x2 and py between d.y1 and d.y2) or sqrt((px - (d.x1+d.x2)/2)*(px - (d.x1+d.x2)/2) + (py - d.y2)*(py - d.y2)) < 20) group by 1, 2"),
    "alignment_sanity": sql("gt_obs detections", f", n as (select g.frame, g.obj_id, min(sqrt((x_m-mx)*(x_m-mx)+(y_m-my)*(y_m-my))) as d from gt_obs g join detections d on g.frame = d.frame group by 1, 2) select count(*) as n, {R('avg(d)')} as mean_m from n"),
    "common_frames": sql("gt_obs positions", "select distinct frame from gt_obs where frame in (select frame from positions)"),
    "id_switches": sql("gt_obs positions", PAIRS + ", m as (select g.frame, g.obj_id, pred_id from gt_obs g left join pairs p on g.frame = p.frame and g.obj_id = p.gt_id), s as (select *, last_value(pred_id ignore nulls) over (partition by obj_id order by frame rows between unbounded preceding and 1 preceding) as last, lag(pred_id) over (partition by obj_id order by frame) as before from m) select obj_id, count(case when pred_id is not null and last is not null and last <> pred_id then 1 end) as switches, count(case when pred_id is not null and last is not null and before is null then 1 end) as fragments from s group by 1"),
    "fragmentation": sql("gt_obs positions", PAIRS + " select gt_id, count(distinct pred_id) as ids, count(*) as frames from pairs group by 1"),
    "team_accuracy": sql("gt_obs positions", PAIRS + ", v as (select pred_id, team, count(*) as n, min(p.frame * 1000 + gt_id) as seen from pairs p join gt_obs g on p.frame = g.frame and p.gt_id = g.obj_id where team is not null group by 1, 2), t as (select pred_id, team as truth from (select *, row_number() over (partition by pred_id order by n desc, seen) as r from v) where r = 1), d as (select obj_id as pred_id, arg_min(team, frame) as declared from pred group by 1) select pred_id, declared, truth, declared = truth as right from t join d using (pred_id)"),
    "coverage_swap": sql("gt_obs positions", PAIRS + f", m as (select {_GROUP.format('g.team')} as truth, {_GROUP.format('q.team')} as said from gt_obs g left join pairs p on g.frame = p.frame and g.obj_id = p.gt_id left join pred q on q.frame = p.frame and q.obj_id = p.pred_id), b as (select truth, count(*) as n, count(case when said = truth then 1 end) as d, count(case when {_SW.format('said')} = truth then 1 end) as s from m where truth is not null group by 1) select truth, n, case when (select sum(s) > sum(d) from b) then s else d end as hits, {R('(case when (select sum(s) > sum(d) from b) then s else d end) * 1e0 / n')} as coverage, (select sum(s) > sum(d) from b) as swapped from b"),
    "team_confusion": sql("gt_obs positions", PAIRS + f", m as (select g.team as truth, q.team as said from pairs p join gt_obs g on g.frame = p.frame and g.obj_id = p.gt_id join pred q on q.frame = p.frame and q.obj_id = p.pred_id where g.team is not null), t as (select count(case when {_SW.format('said')} = truth then 1 end) > count(case when said = truth then 1 end) as sw from m) select truth, case when sw then {_SW.format('said')} else said end as said, count(*) as n from m, t group by 1, 2"),
    "concurrency": sql("gt_obs positions", PAIRS + f", f as (select distinct frame from gt_obs where frame in (select frame from positions)), s as (select f.frame, (select count(*) from pred p where p.frame = f.frame) as p, (select count(*) from gt_obs g where g.frame = f.frame) as g from f) select median(p) as pred_median, {R('quantile_cont(p, 0.9e0)')} as pred_p90, max(p) as pred_max, median(g) as gt_median, {R('quantile_cont(g, 0.9e0)')} as gt_p90, median(p) - median(g) as excess from s"),
    "impossible_transitions": sql("positions", SPEEDS + f", c as (select *, speed > 2e0 as fast, case when (speed > 2e0) = lag(speed > 2e0) over (partition by id_jugador order by frame) then 0 else 1 end as ch from speeds), r as (select *, sum(ch) over (partition by id_jugador order by frame) as run from c), k as (select id_jugador, max(tiempo_s) - min(prev_t) as d from r where fast group by id_jugador, run having max(tiempo_s) - min(prev_t) >= 0.3e0) select count(*) as runs, count(distinct id_jugador) as ids, {R('coalesce(sum(d), 0)')} as seconds, {R('(select max(speed) from speeds)')} as top_speed from k"),
    "count_identity": sql("gt_obs positions", PAIRS + ", f as (select distinct frame from gt_obs where frame in (select frame from pred)), s as (select (select count(*) from gt_obs g where g.frame = f.frame) as t, (select count(*) from pred p where p.frame = f.frame) as r, (select count(*) from pairs q where q.frame = f.frame) as m from f) select cast(sum(t) as bigint) as truths, cast(sum(r) as bigint) as rows, cast(sum(t - m) as bigint) as missed, cast(sum(r - m) as bigint) as extra, cast(sum(r - (t - (t - m) + (r - m))) as bigint) as off from s"),
    "localisation_by_band": sql("gt_obs positions", PAIRS + f", m as (select case when y_m > 0 and y_m <= 16 then 0 when y_m > 16 and y_m <= 32 then 1 when y_m > 32 and y_m <= 48 then 2 when y_m > 48 and y_m <= 64 then 3 end as band, distance from gt_obs g left join pairs p on g.frame = p.frame and g.obj_id = p.gt_id) select band, count(*) as n, count(distance) as matched, {R('avg(distance)')} as mean_m, {R('median(distance)')} as median_m, {R('quantile_cont(distance, 0.9e0)')} as p90_m from m group by 1"),
    "team_crossings": sql("gt_obs positions", PAIRS + f", b as (select pred_id, count(distinct gt_id) as people, count(distinct {_GROUP.format('team')}) as teams from pairs p join gt_obs g on g.frame = p.frame and g.obj_id = p.gt_id group by 1) select case when teams > 1 then 'cross' when people > 1 then 'same' else 'pure' end as kind, count(*) as ids from b group by 1"),
    "identity_purity": sql("gt_obs positions", PAIRS + f", c as (select pred_id, gt_id, count(*) as n from pairs group by 1, 2), s as (select pred_id, max(n) as top, cast(sum(n) as bigint) as n from c group by 1), ch as (select pred_id, count(case when b <> gt_id then 1 end) as changes from (select *, lag(gt_id) over (partition by pred_id order by frame, gt_id) as b from pairs) group by 1) select pred_id, n, {R('top * 1e0 / n')} as purity, changes from s join ch using (pred_id)"),
    "first_lost": sql("gt_obs positions", PAIRS + ", m as (select case when p.gt_id is null then 'found' when distance >= 0.4e0 then 'near' end as lost_at from gt_obs g left join pairs p on g.frame = p.frame and g.obj_id = p.gt_id) select lost_at, count(*) as n from m group by 1"),
    "proximity": sql("gt_obs positions", PAIRS + f", n as (select a.frame, a.obj_id, min(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m))) as d from gt_obs a left join gt_obs b on a.frame = b.frame and a.obj_id <> b.obj_id group by 1, 2) select n.frame, n.obj_id, {R('d')} as neighbour_m, case when p.gt_id is null then 0 else 1 end as found from n left join pairs p on n.frame = p.frame and n.obj_id = p.gt_id"),
    "duplicate_pairs": sql("positions", f"select a.id_jugador as a, b.id_jugador as b, count(*) as shared, {R('median(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m)))')} as median_m from positions a join positions b on a.frame = b.frame and a.id_jugador < b.id_jugador group by 1, 2 having count(*) >= 3 and median(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m))) <= 6"),
    "crossing_frames": sql("detections", _IOU + " select distinct frame from m where max_iou > 0.10e0"),
    "prototype_predict": sql("features", f", d as (select frame, det_idx, {_DIST(0)} as a, {_DIST(1)} as b, {_DIST(2)} as o from features) select frame, det_idx, case when least(a, b, o) > sqrt(2e0) then 'otro' when a <= b and a <= o then 'A' when b <= o then 'B' else 'otro' end as team, {R('least(a, b, o)', 5)} as away from d"),
    "defended_sides": sql("positions", f", m as (select avg(case when equipo = 0 then x_m end) as a, avg(case when equipo = 1 then x_m end) as b from positions where equipo in (0,1) and x_m between 0 and 100 and y_m between 0 and 64 and etiqueta not like 'portero%') select {R('a')} as a_x, {R('b')} as b_x, case when abs(a - b) < 2 then null when a < b then 'A left' else 'B left' end as sides from m"),
    "goalkeeper_area": sql("positions", ", p as (select * replace (case when etiqueta like 'portero%' then 30 + y_m % 4 else y_m end as y_m) from positions), m as (select id_jugador, median(x_m) as mx, median(y_m) as my from p group by 1), l as (select id_jugador, case when mx <= 17.5e0 then 0 when mx >= 82.5e0 then 1 end as side from m where abs(my - 32) <= 21.16e0), n as (select l.side, l.id_jugador, count(*) as n from l join p on p.id_jugador = l.id_jugador and abs(p.y_m - 32) <= 21.16e0 and ((l.side = 0 and p.x_m <= 17.5e0) or (l.side = 1 and p.x_m >= 82.5e0)) group by 1, 2) select side, id_jugador, n from (select *, row_number() over (partition by side order by n desc, id_jugador desc) as r from n) where r = 1"),
    "last_man": sql("positions", f", t as (select * from positions where equipo in (0,1)), e as (select frame, 0 as side, id_jugador from (select *, row_number() over (partition by frame order by x_m, id_jugador) as r from t) where r = 1 union all select frame, 1, id_jugador from (select *, row_number() over (partition by frame order by x_m desc, id_jugador desc) as r from t) where r = 1), h as (select side, id_jugador, count(*) as hits from e group by 1, 2), s as (select id_jugador, count(*) as seen from t group by 1), w as (select *, hits * 1e0 / seen as p from h join s using (id_jugador)) select side, id_jugador, hits, seen, {R('greatest((p + 1.96e0*1.96e0/(2*seen) - 1.96e0 * sqrt((p*(1-p) + 1.96e0*1.96e0/(4*seen))/seen)) / (1 + 1.96e0*1.96e0/seen), 0)')} as score from w"),
    "staff_rule": sql("positions", SPEEDS + f", o as (select id_jugador, median(greatest({_EDGE}, 0)) as o, median({_EDGE}) as e, count(*) as n, max(case when etiqueta like 'portero%' then 1 else 0 end) as k from positions group by 1), v as (select id_jugador, sum(step_m)/sum(dt) as v from speeds group by 1) select o.id_jugador, {R('o')} as out_m, n from o left join v using (id_jugador) where (o > 2 and (n >= 5 or o > 6)) or (e > -2 and v < 0.6e0 and n >= 25 and k = 0)"),
    "one_referee": sql("positions", "select id_jugador, count(*) as n from positions where equipo = 2 and x_m between 0 and 100 and y_m between 0 and 64 group by 1 having count(*) >= 25 order by n desc, id_jugador limit 1"),
    "emission_model": sql("positions", f", b as (select case when y_m < 10 then 0 when y_m < 20 then 1 when y_m < 30 then 2 when y_m < 40 then 3 else 4 end as bin, etiqueta = 'otro' as ref from positions), n as (select g.bin, count(case when ref then 1 end) as y, count(case when not ref then 1 end) as n from (select unnest([0,1,2,3,4]) as bin) g left join b using (bin) group by 1) select bin, {R('ln((y + 1) / ((select sum(y) from n) + 5e0)) - ln((n + 1) / ((select sum(n) from n) + 5e0))')} as log_lr from n"),
    "ball_plausible": sql("ball_cand", "select frame, cand_idx from ball_cand where mx*1.5e0 between -3 and 103 and my between -3 and 67"),
    "static_marks": sql("ball_cand", _MARKS + " select cx, cy from cells"),
    "without_marks": sql("ball_cand", _MARKS + " select frame, cand_idx from ball_cand where (floor(px/12), floor(py/12)) not in (select (cx, cy) from cells)"),
    "mark_share": sql("ball_cand", _MARKS + f" select count(*) as n, count(case when c.cx is not null then 1 end) as on_marks, {R('count(case when c.cx is not null then 1 end) * 1e0 / count(*)')} as share from ball_cand left join cells c on floor(px/12) = c.cx and floor(py/12) = c.cy"),
    "ball_nearest_pick": sql("ball_cand positions", _PICK + " select frame, cand_idx from pk"),
    "ball_segments": sql("ball_cand positions", _PICK + ", c as (select frame, case when t - lag(t) over w > 0.5e0 or sqrt((px - lag(px) over w)*(px - lag(px) over w) + (py - lag(py) over w)*(py - lag(py) over w)) > 1000*(t - lag(t) over w) + 20 then 1 else 0 end as cut from pk window w as (order by frame)) select frame, cast(sum(cut) over (order by frame) as int) as segment from c"),
    "ball_quality": sql("ball_cand", "select frame, cand_idx, case when mx > 60 then 'out' when h_px > 11 then 'aerial' when not conf > 0.5e0 then 'filled' else 'measured' end as quality from ball_cand"),
    "possession": sql("ball_cand positions", _OWN + " select frame, id_jugador, equipo from own"),
    "possession_changes": sql("ball_cand positions", _OWN + " select frame, b as before, equipo as after from (select *, lag(equipo) over (order by frame) as b from own) where b <> equipo"),
    "possession_zone_corrected": sql("ball_cand positions", _OWN + f", z as (select least(greatest(floor(mx*3/100e0), 0), 2) as z, count(*) as seen from ball_cand where cand_idx = 0 group by 1), g as (select least(greatest(floor(mx*3/100e0), 0), 2) as z, equipo, count(*) as n from own group by 1, 2), w as (select g.equipo, n, seen * 1e0 / (sum(n) over (partition by g.z)) as w from g join z using (z)), s as (select equipo, cast(sum(n) as bigint) as frames, sum(n * w) as w from w group by 1) select equipo, frames, {R('w / sum(w) over ()')} as share from s"),
    "ball_gaps": sql("ball_cand", f", g as (select frame, t, mx, lead(t) over (order by frame) - t as gap_s from ball_cand where cand_idx = 0 and frame % 100 < 60) select frame, {R('gap_s')} as gap_s from g where gap_s > 1 and gap_s < 8 and mx >= 20"),
    "combined_table": sql("positions ball_cand", "select frame, tiempo_s, id_jugador, equipo, etiqueta, x_m, y_m, es_real from positions union all select frame, t, -1, 3, 'balon', mx, my, null from ball_cand where cand_idx = 0"),
    "ball_fill": sql("ball_cand", f", tr as (select * from ball_cand where cand_idx = 0 and frame % 10 < 6), l as (select frame, t, mx, my, lead(frame) over w as nf, lead(t) over w as nt, lead(mx) over w as nx, lead(my) over w as ny from tr window w as (order by frame)), h as (select *, case when nt - t <= 1.2e0 and sqrt((nx-mx)*(nx-mx)+(ny-my)*(ny-my))/(nt-t) <= 12 and (mx+nx)/2 >= 20 then 'line' when nt - t <= 0.4e0 and sqrt((nx-mx)*(nx-mx)+(ny-my)*(ny-my))/(nt-t) <= 4 then 'hold' end as how from l where nf - frame > 2), f as (select distinct frame as ff, t as ft from ball_cand) select ff as frame, how, {R('mx + (case when how = chr(108)||chr(105)||chr(110)||chr(101) then (ft - t)/(nt - t) else 0 end) * (nx - mx)')} as mx, {R('my + (case when how = chr(108)||chr(105)||chr(110)||chr(101) then (ft - t)/(nt - t) else 0 end) * (ny - my)')} as my from h join f on ff > frame and ff < nf where how is not null".replace("chr(108)||chr(105)||chr(110)||chr(101)", "'line'")),
    "coverage_holes": sql("detections", "select frame as before, after, cast(floor((after - frame) / 3) - 1 as int) as missing from (select frame, lead(frame) over (order by frame) as after from (select distinct frame from detections where frame % 90 < 75)) where after - frame > 3"),
    "merge_partial_caches": sql("detections", f", m as (select frame, conf from detections where frame < 700 union all select frame, conf * 0.5e0 from detections where frame >= 700) select frame < 700 as first, count(*) as n, {R('sum(conf)')} as conf from m group by 1"),
    "cache_round_trip": sql("detections", "select frame, det_idx, mx, conf from detections"),
    "mot_export": sql("gt_obs", f"select cast(dense_rank() over (order by frame) as int) as frame, obj_id as id, 2e0 as width, {R('x_m - 1')} as left, {R('y_m - 1')} as top from gt_obs"),
    "cvat_round_trip": sql("gt_obs", f", c as (select *, x_m * 10 as px, y_m * 10 + 50 as py from gt_obs) select cast(dense_rank() over (order by frame) - 1 as int) as frame, cast(dense_rank() over (order by obj_id) - 1 as bigint) as obj_id, label, team, {R('px - 9', 2)} as x1, {R('py - 40', 2)} as y1, {R('px + 9', 2)} as x2, {R('py', 2)} as y2 from c"),
    "edge_clicks": sql("detections", "select frame, det_idx from detections where (x1 + x2) / 2 <= 2 or y2 <= 2 or (x1 + x2) / 2 >= 350 - 1 - 2 or y2 >= 540 - 1 - 2"),
    "plan_segments": "select cast(i as int) as segment, i * 570e0 as start_s, least(i * 570e0 + 600, 5400e0) as end_s from range(10) t(i)",
    "resume_frames": sql("detections", "select distinct frame from detections where frame >= 600"),
    "same_settings": "select cast(2 as bigint) as settings",
    "metrics_json": sql("positions", "select '{\"equipo\":' || equipo || ',\"n\":' || count(*) || '}' as json from positions group by equipo"),
}
