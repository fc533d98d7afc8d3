"""Profiles, reviews and further comparisons as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import ball, crossings, filters, matching, metrics, review, teams, tracking
from . import matches, profiles
from .base import PAIRS, Query, R, over, sql
from .q_tracking import _DIST, _GROUP, _IOU, _PROTO, _pairs, _pred, _q

_TEAM = "positions where equipo in (0, 1)"


def _aerial(b):
    return b.where("cand_idx = 0").withColumn("aerial", F.col("frame") % 50 < 8)


def _lifted(p):
    """The same match three times: metrics of each must be those of one."""
    three = p.crossJoin(F.broadcast(p.sparkSession.range(3).select(F.col("id").alias("match_no"))))
    up = matches.lifted(three)
    return matches.lowered(metrics.blocks(up), ids=()).groupBy("match_no").agg(F.count("*").alias("n"), fn.rounded(F.avg("cx"), 4).alias("cx"))


def _crossed(p, d):
    """Positions with the number of their detection and whether its box touches another."""
    numbered = p.withColumn("det_idx", (F.row_number().over(W.partitionBy("frame").orderBy("id_jugador")) - 1).cast("int"))
    touching = filters.occluded(d).select("frame", "det_idx", F.lit(True).alias("crossed"))
    return numbered.join(touching, ["frame", "det_idx"], "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))


QUERIES: dict[str, Query] = {
    "profile_candidato": over("detections")(lambda d: profiles.run(d)),
    "profile_oficial": over("detections")(lambda d: profiles.run(d, profiles.Profile("oficial"))),
    "profile_bytetrack": over("detections")(lambda d: profiles.run(d, profiles.Profile("bytetrack"))),
    "worst_windows": over("positions")(lambda p: review.worst_windows(p).select("start_s", fn.rounded(F.col("rate")).alias("rate"))),
    "play_score": over("ball_cand")(lambda b: review.play_score(b.where("cand_idx = 0"))),
    "sample_phase": over("positions")(lambda p: review.phases(p, 6, 3).select("frame", "id_jugador")),
    "sub_match": over("positions", "gt_obs")(lambda p, g: review.sub_match(p, g).select("frame", "id_jugador")),
    "oracle_position": over("gt_obs", "positions")(lambda g, p: _q(review.oracle(_pred(p), g, _pairs(g, p), "position"), "x_m", "y_m", keep=("frame", "obj_id"))),
    "oracle_identity": over("gt_obs", "positions")(lambda g, p: review.oracle(_pred(p), g, _pairs(g, p), "identity").select("frame", "obj_id")),
    "team_error": over("gt_obs", "positions")(lambda g, p: review.team_error(_pairs(g, p), g, _pred(p))),
    "reappearance": over("gt_obs", "positions")(lambda g, p: review.reappearance(g, matching.nearest(g, _pred(p), 0.45))),
    "score_inversions": over("ball_cand")(lambda b: review.score_inversions(b.where("cand_idx = 1"), b.where("cand_idx = 0"))),
    "readmitted_flights": over("ball_cand")(lambda b: review.readmitted_flights(_aerial(b)).select("frame", "readmitted")),
    "field_prior": over("ball_cand")(lambda b: review.field_prior(b.withColumn("mx", F.when(F.col("frame") % 30 == 0, 150.0).otherwise(F.col("mx"))), 100.0, 64.0, seconds=120.0).select("frame", "cand_idx")),
    "relink_at_crossings": over("positions", "detections")(lambda p, d: crossings.relink(_crossed(p, d)).groupBy("piece_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("kept"), 1)).alias("kept"))),
    "relink_by_look": over("positions", "detections", "features")(lambda p, d, f: crossings.relink(_crossed(p, d).join(f.select("frame", "det_idx", "feat"), ["frame", "det_idx"], "left"), vector="feat", separation=1.4).groupBy("piece_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("kept"), 1)).alias("kept"))),
    "crossing_pieces": over("positions", "detections")(lambda p, d: crossings.pieces(_crossed(p, d)).groupBy("id_jugador", "piece").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))),
    "scaled_windows": over("positions")(lambda p: review.scaled_windows(p.withColumn("factor", 1.0 + F.col("y_m") / 64.0))),
    "smooth_ball": over("ball_cand")(lambda b: _q(review.smooth_ball(_aerial(b)), "bx", "by", keep=("frame",))),
    "prototype_drift": over("features")(lambda f: review.prototype_drift(f, 30, _PROTO.a, _PROTO.b)),
    "reweighted": over("positions", "gt_obs")(lambda p, g: review.reweighted(p.select("frame", "id_jugador", (F.col("frame") % 4).alias("stratum")), g.select((F.col("frame") % 4).alias("stratum"))).groupBy("stratum").agg(F.count("*").alias("n"), fn.rounded(F.sum("weight"), 5).alias("w"))),
    "noise_whole_frames": over("detections")(lambda d: review.noisy(d, 0.1, "frame").select("frame", "det_idx")),
    "noise_surest": over("detections")(lambda d: review.noisy(d, 0.2, "confidence").select("frame", "det_idx")),
    "dominant_zone": over("positions")(review.dominant_zone),
    "many_matches": over("positions")(_lifted),
    "hue_saturation": over("features")(lambda f: f.select("frame", "det_idx", *(c.alias(n) for c, n in zip(fn.hue_saturation(F.col("feat"), 8), ("hue", "saturation"), strict=True)))),
    "brightness": over("features")(lambda f: f.select("frame", "det_idx", fn.rounded(fn.brightness(F.transform("feat", lambda x: F.abs(x.cast("double"))), 17, 16), 4).alias("value"))),
    "referee_kit": over("features")(lambda f: teams.matching_kits(f.withColumn("feat", F.concat("feat", F.array_repeat(F.lit(-9.0).cast("float"), 192))), [teams.Kit("low", (0.0, 22.5), (0.0, 256.0)), teams.Kit("high", (22.5, 180.0), (0.0, 128.0))], []).groupBy("kit").agg(F.count("*").alias("n"))),
    "displaced_pairs": over("gt_obs", "positions")(lambda g, p: matching.optimal_then_threshold(g, _pred(p).withColumn("x_m", F.col("x_m") + 3), 5.0)),
    "pixels_per_metre": over("ball_cand")(lambda b: b.select("frame", "cand_idx", fn.rounded(fn.relative_size(F.col("h_px"), F.col("px"), F.col("py"), [[0.05, 0.0, 0.0], [0.0, 0.08, 0.0], [0.0, 0.0, 1.0]])).alias("size"))),
    "clock": over("positions")(lambda p: p.select("frame", fn.clock(F.col("tiempo_s") * 10).alias("clock")).distinct()),
    "ball_anchor_share": over("ball_cand")(lambda b: ball.anchored(b.where("cand_idx = 0"), 3.0)),
    "truth_identity_map": over("gt_obs", "positions")(lambda g, p: matching.identity_map(_pairs(g, p))),
}

_RUNS = ", r as (select *, sum(ch) over (order by frame) as run from (select *, case when aerial = lag(aerial) over (order by frame) then 0 else 1 end as ch from (select *, frame % 50 < 8 as aerial from ball_cand where cand_idx = 0)))"

ORACLES: dict[str, str] = {
    "crossing_pieces": sql("positions detections", _IOU + """, c as (select p.*, oc.det_idx is not null as crossed from (select *, cast(row_number() over (partition by frame order by id_jugador) - 1 as int) as det_idx from positions) p left join (select frame, det_idx from m where max_iou > 0.10e0) oc using (frame, det_idx)),
 b as (select *, not crossed and coalesce(lag(crossed) over (partition by id_jugador order by frame), true) as begins from c),
 n as (select id_jugador, frame, cast(id_jugador as bigint) * 1000000 + cast(greatest(sum(case when begins then 1 else 0 end) over (partition by id_jugador order by frame), 1) as bigint) as piece from b)
 select id_jugador, piece, count(*) as n, min(frame) as first, max(frame) as last from n group by 1, 2"""),
    "play_score": sql("ball_cand", f", s as (select t, sqrt((mx - lag(mx) over w)*(mx - lag(mx) over w) + (my - lag(my) over w)*(my - lag(my) over w)) / (t - lag(t) over w) as v from ball_cand where cand_idx = 0 window w as (order by frame)), e as (select v, unnest(generate_series(greatest(cast(floor((t - 60) / 10) as bigint) + 1, 0), cast(floor(t / 10) as bigint))) as k from s) select k * 10 as start_s, count(*) as n, {R('avg(case when v is null then 10e0 else least(v, 10e0) end)', 5)} as mean_v from e group by 1"),
    "sample_phase": sql("positions", "select frame, id_jugador from positions where frame % 6 = 3"),
    "sub_match": sql("positions gt_obs", "select frame, id_jugador from positions where frame in (select frame from gt_obs)"),
    "team_error": sql("gt_obs positions", PAIRS + f", m as (select {_GROUP.format('g.team')} as truth, {_GROUP.format('q.team')} as said, p.pred_id as hit from gt_obs g left join pairs p on g.frame = p.frame and g.obj_id = p.gt_id left join pred q on q.frame = p.frame and q.obj_id = p.pred_id), s as (select count(*) as n, count(case when hit is null then 1 end) as u, count(case when hit is not null and said is null then 1 end) as o, count(case when said <> truth then 1 end) as x, count(case when said = truth then 1 end) as y from m where truth is not null) select n, {R('u * 1e0 / n')} as unmatched, {R('o * 1e0 / n')} as other, {R('least(x, y) * 1e0 / n')} as wrong from s"),
    "reappearance": sql("gt_obs positions", PAIRS.replace("distance <= 2e0", "distance <= 0.45e0") + ", m as (select g.frame, g.obj_id, p.gt_id as hit from gt_obs g left join pairs p on g.frame = p.frame and g.obj_id = p.gt_id), l as (select obj_id, min(case when hit is null then frame end) as lost from m group by 1) select l.obj_id, lost, min(case when m.frame > lost and hit is not null then m.frame end) as back from l join m using (obj_id) group by 1, 2"),
    "score_inversions": sql("ball_cand", ", s as (select t as st, conf as sc from ball_cand where cand_idx = 0), c as (select b.frame, b.conf, sc, row_number() over (partition by b.frame order by abs(t - st), st) as r from ball_cand b join s on abs(t - st) <= 1 where b.cand_idx = 1) select count(*) as n, count(case when conf > sc then 1 end) as inversions from c where r = 1"),
    "readmitted_flights": sql("ball_cand", _RUNS + ", b as (select run, aerial, min(t) as a, max(t) as z from r group by 1, 2) select r.frame, r.aerial and r.run > 1 and r.run < (select max(run) from r) and z - a <= 2.5e0 as readmitted from r join b using (run)"),
    "reweighted": sql("positions gt_obs", f", s as (select frame % 4 as stratum, count(*) as n from positions group by 1), r as (select frame % 4 as stratum, count(*) as r from gt_obs group by 1) select stratum, n, {R('r * 1e0', 5)} as w from s join r using (stratum)"),
    "noise_surest": sql("detections", ", r as (select *, percent_rank() over (partition by frame order by conf desc, det_idx) as r from detections) select frame, det_idx from r where r >= 0.2e0"),
    "dominant_zone": sql("positions", ", z as (select id_jugador, case when x_m < 100e0/3 then 'left' when x_m < 200e0/3 then 'middle' else 'right' end as zone, count(*) as n from positions group by 1, 2) select id_jugador, zone, n from (select *, row_number() over (partition by id_jugador order by n desc, zone) as r from z) where r = 1"),
    "many_matches": sql("positions", f", b as (select frame, equipo, {R('avg(x_m)')} as cx from {_TEAM} group by 1, 2 having count(*) >= 3) select cast(m as int) as match_no, count(*) as n, {R('avg(cx)', 4)} as cx from b, range(3) t(m) group by 1"),
    "hue_saturation": sql("features", "select frame, det_idx, ((list_position(feat, list_max(feat)) - 1) // 8 + 0.5e0) * 22.5e0 as hue, ((list_position(feat, list_max(feat)) - 1) % 8 + 0.5e0) * 32e0 as saturation from features"),
    "brightness": sql("features", f", b as (select frame, det_idx, list_transform(feat[17:32], lambda x: abs(cast(x as double))) as v from features) select frame, det_idx, {R('list_sum(list_transform(v, lambda x, i: x * (i - 0.5e0) * 16e0)) / list_sum(v)', 4)} as value from b"),
    "pixels_per_metre": sql("ball_cand", f"select frame, cand_idx, {R('h_px / (0.22e0 * (1 / 0.05e0))')} as size from ball_cand"),
    "clock": sql("positions", "select distinct frame, printf('%02d:%02d', cast(floor(tiempo_s * 10 / 60) as int), cast(floor(tiempo_s * 10) as int) % 60) as clock from positions"),
    "oracle_position": sql("gt_obs positions", PAIRS + f", t as (select p.frame, p.pred_id, arg_min(g.x_m, p.distance) as gx, arg_min(g.y_m, p.distance) as gy, count(*) as n from pairs p join gt_obs g on g.frame = p.frame and g.obj_id = p.gt_id group by 1, 2) select q.frame, q.obj_id, {R('coalesce(g.x_m, q.x_m)')} as x_m, {R('coalesce(g.y_m, q.y_m)')} as y_m from pred q left join pairs p on q.frame = p.frame and q.obj_id = p.pred_id left join gt_obs g on g.frame = p.frame and g.obj_id = p.gt_id"),
    "oracle_identity": sql("gt_obs positions", PAIRS + " select q.frame, coalesce(p.gt_id, q.obj_id) as obj_id from pred q left join pairs p on q.frame = p.frame and q.obj_id = p.pred_id"),
    "prototype_drift": sql("features", f", d as (select frame, det_idx, feat, {_DIST(0)} as a, {_DIST(1)} as b from features), n as (select cast(floor(frame / 30) as int) as segment, case when a <= b then 'A' else 'B' end as team, feat from d), e as (select segment, team, unnest(feat) as v, unnest(range(len(feat))) as k from n), m as (select segment, team, k, avg(cast(v as double)) as m from e group by 1, 2, 3) select segment, team, {R('sqrt(sum((m - case when (team = ' + chr(39) + 'A' + chr(39) + ' and k = 0) or (team = ' + chr(39) + 'B' + chr(39) + ' and k = 1) then 1e0 else 0e0 end) * (m - case when (team = ' + chr(39) + 'A' + chr(39) + ' and k = 0) or (team = ' + chr(39) + 'B' + chr(39) + ' and k = 1) then 1e0 else 0e0 end)))', 5)} as away from m group by 1, 2"),
}
