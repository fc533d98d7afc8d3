"""Collective metrics, reports and replays as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, islands, metrics, smoothing, tracking
from .base import SPEEDS, Query, R, over, sql

_TEAM = "positions where equipo in (0, 1)"
_HEIGHT = """, goal as (select equipo, case when median(x_m) < 50e0 then 0e0 else 100e0 end as gx from positions where equipo in (0,1) and etiqueta like 'portero%' group by 1),
 h as (select p.*, abs(x_m - gx) as height from positions p join goal using (equipo) where p.etiqueta not like 'portero%')"""
_LINES = _HEIGHT + f""", r as (select *, row_number() over (partition by frame, equipo order by height, id_jugador) as low, count(*) over (partition by frame, equipo) as n from h),
 lines as (select frame, equipo, {R("avg(case when low <= 4 then height end)")} as defence_m, {R("avg(case when low > n - 3 then height end)")} as attack_m, {R("avg(height)")} as block_m from r where n >= 7 group by 1, 2)"""


def _summary_sql(by: str) -> str:
    pct = lambda c: R(f"100e0 * sum(case when {c} then 1 else 0 end) / count(*)")
    key, group = (f"{by}, ", f" group by {by}") if by else ("", "")
    return sql("positions", f"""select {key}count(*) as n, count(distinct id_jugador) as ids, count(distinct frame) as frames,
 {R("avg(x_m)")} as x_m, {R("avg(y_m)")} as y_m, {R("2 * stddev_samp(y_m)")} as width_m, {R("2 * stddev_samp(x_m)")} as depth_m,
 {pct("x_m < 100e0/3")} as left_pct, {pct("x_m >= 100e0/3 and x_m < 200e0/3")} as middle_pct, {pct("x_m >= 200e0/3")} as right_pct from {_TEAM}{group}""")


def _blocks(table: str = "positions") -> str:
    return f"""select frame, equipo, count(*) as n, {R("avg(x_m)")} as cx, {R("avg(y_m)")} as cy, max(x_m) - min(x_m) as depth_m, max(y_m) - min(y_m) as width_m
 from {table} where equipo in (0, 1) group by 1, 2 having count(*) >= 3"""


_GT_ROWS = ", gt as (select frame, obj_id as id_jugador, x_m, y_m, case when team in ('A','portero_A') then 0 when team in ('B','portero_B') then 1 else 2 end as equipo from gt_obs)"


def _gt(gt):
    return gt.select("frame", F.col("obj_id").alias("id_jugador"), "x_m", "y_m", F.when(F.col("team").isin("A", "portero_A"), 0).when(F.col("team").isin("B", "portero_B"), 1).otherwise(2).alias("equipo"))


def _label_runs(p):
    noisy = F.when((F.col("frame") / 3 + F.col("id_jugador")) % 11 < 3, F.lit("x")).otherwise(F.col("etiqueta"))
    r = metrics.label_runs(p, noisy)
    return r.groupBy("label").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.max("n").alias("longest"))


_HALF = ", hr as (select frame, tiempo_s, id_jugador, equipo, x_m, y_m, case when (frame // 3 + id_jugador) % 5 < 2 then 0 else 1 end as es_real, case when frame % 4 = 0 then 'A' else etiqueta end as etiqueta from positions)"


def _half(p):
    f = (F.col("frame") / 3).cast("int")
    return p.withColumns({"es_real": F.when((f + F.col("id_jugador")) % 5 < 2, 0).otherwise(1), "etiqueta": F.when(F.col("frame") % 4 == 0, "A").otherwise(F.col("etiqueta"))})


def _frames(p):
    return p.select("frame", "tiempo_s").distinct()


def _fill(p):
    r = smoothing.fill_gaps(_half(p), _frames(p), 0.5)
    from ..functions import rounded

    return r.select("id_jugador", "frame", rounded(F.col("x_m")).alias("x_m"), rounded(F.col("y_m")).alias("y_m"), "es_real")


def _rounded(df, *cols):
    from ..functions import rounded

    return df.select("id_jugador", "frame", *(rounded(F.col(c), 5).alias(c) for c in cols))


def _savgol_sql() -> str:
    from ..functions import savitzky_golay_weights

    w = savitzky_golay_weights(7)
    term = lambda c: " + ".join(f"{x!r}e0 * lag({c}, {-k}) over w" if k < 0 else (f"{x!r}e0 * lead({c}, {k}) over w" if k else f"{x!r}e0 * {c}") for k, x in zip(range(-3, 4), w, strict=True))
    return sql("positions", f""", s as (select id_jugador, frame, x_m, y_m, row_number() over w as i, count(*) over (partition by id_jugador) as n, {term("x_m")} as gx, {term("y_m")} as gy
 from positions window w as (partition by id_jugador order by frame))
 select id_jugador, frame, {R("case when n >= 7 and i > 3 and i <= n - 3 then gx else x_m end", 5)} as sx, {R("case when n >= 7 and i > 3 and i <= n - 3 then gy else y_m end", 5)} as sy from s""")


def _moving_sql() -> str:
    m = lambda c: f"case when n < 5 then {c} else (coalesce(sum({c}) over (partition by id_jugador order by frame rows between 2 preceding and 2 following), 0) + greatest(3 - i, 0) * first_value({c}) over (partition by id_jugador order by frame rows between unbounded preceding and unbounded following) + greatest(i + 2 - n, 0) * last_value({c}) over (partition by id_jugador order by frame rows between unbounded preceding and unbounded following)) / 5e0 end"
    return sql("positions", f""", a as (select *, row_number() over (partition by id_jugador order by frame) as i, count(*) over (partition by id_jugador) as n from positions)
 select id_jugador, frame, {R(m("x_m"), 5)} as sx, {R(m("y_m"), 5)} as sy from a""")


def _cut_pieces(p):
    r = smoothing.cut_by_speed(p, v_max=2.5, least_s=0.2, v_jump=6.0)
    return r.groupBy("id_jugador").agg(F.countDistinct("piece").alias("pieces"), F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    "collective_summary": over("positions")(lambda p: metrics.summary(p)),
    "collective_by_team": over("positions")(lambda p: metrics.summary(p, ["equipo"])),
    "heatmap_16x10": over("positions")(metrics.heatmap),
    "fine_heatmap": over("positions")(metrics.fine_heatmap),
    "orientation": over("positions")(metrics.orientation),
    "lines_per_frame": over("positions")(metrics.lines),
    "team_line_metrics": over("positions")(metrics.team_lines),
    "relative_thirds_lanes": over("positions")(metrics.territory),
    "lateral_summary": over("positions")(lambda p: metrics.series_summary(metrics.lateral_shift(p, 16), "equipo", "shift_m")),
    "lateral_shift": over("positions")(lambda p: metrics.lateral_shift(p, 16)),
    "block_metrics": over("positions")(metrics.blocks),
    "headcount_pivot": over("positions", "detections")(metrics.head_count),
    "cardinality_violations": over("positions", "detections")(lambda p, d: metrics.surplus_others(p, d, 0)),
    "drift_by_segment": over("positions")(lambda p: metrics.drift(p, 10.0)),
    "episodes_15s": over("positions")(metrics.episodes),
    "sliding_30s_windows": over("positions")(metrics.sliding_windows),
    "funnel": over("detections", "positions")(metrics.funnel),
    "team_flip_runs": over("positions")(_label_runs),
    "jump_events": over("positions")(lambda p: metrics.jumps(p, 1.0, 0.35).select("id_jugador", "frame", "prev_frame")),
    "reentries": over("positions")(lambda p: metrics.reentries(p, 0.2).select("id_jugador", "frame", "prev_frame")),
    "tactical_lines": over("positions")(metrics.tactical_lines),
    "densest_window": over("positions")(metrics.densest_window),
    "deepest_n": over("positions")(lambda p: metrics.deepest(p).select("frame", "equipo", F.array_join("line", ",").alias("line"), "height_m")),
    "fixed_bins": over("positions")(lambda p: metrics.fixed_bins(p, F.col("x_m"), [0.0, 25.0, 50.0, 75.0, 100.0])),
    "quantile_bins": over("positions")(lambda p: metrics.quantile_bins(p, "x_m").groupBy("bin").agg(F.count("*").alias("n"))),
    "label_mode": over("positions")(metrics.label_mode),
    "distance_run": over("positions")(metrics.per_player),
    "product_error_vs_gt": over("gt_obs", "positions")(lambda g, p: metrics.product_error(_gt(g), p)),
    "occupancy_error": over("gt_obs", "positions")(lambda g, p: metrics.occupancy_error(_gt(g), p)),
    "bin_proxies": over("positions")(lambda p: metrics.bin_proxies(p.withColumn("x_m", F.when(F.col("frame") % 7 == 0, F.col("x_m") + 9e0).otherwise(F.col("x_m"))))),
    "weighted_quantile": over("positions")(lambda p: metrics.weighted_quantile(p, "x_m", "id_jugador", 0.5)),
    "leave_out": over("detections")(lambda d: metrics.leave_out(d, 0.1).select("frame", "det_idx")),
    "showable": over("positions")(lambda p: metrics.showable(islands.speeds(p), "step_m", 1.0, 3.0).select("n", "show")),
    "gap_fill_linear": over("positions")(_fill),
    "moving_average_edge": over("positions")(lambda p: _rounded(smoothing.moving_average(p, 5), "sx", "sy")),
    "savgol_interior": over("positions")(lambda p: _rounded(smoothing.savitzky_golay(p, 7), "sx", "sy")),
    "smooth_in_time": over("positions")(lambda p: _rounded(smoothing.within_time(p, 9), "sx", "sy")),
    "smooth_in_segments": over("positions")(lambda p: _rounded(smoothing.within_segments(p, 9, 2.5), "sx", "sy")),
    "jitter_sigma": over("positions")(smoothing.jitter),
    "label_propagation": over("positions")(lambda p: smoothing.spread_labels(_half(p)).select("id_jugador", "frame", "label")),
    "visual_median": over("positions")(lambda p: smoothing.visual_median(_half(p)).select("id_jugador", "frame", "shown")),
    "visual_hysteresis": over("positions")(lambda p: smoothing.visual_hysteresis(_half(p), 0.3).select("id_jugador", "frame", "shown")),
    "moving_majority": over("positions")(lambda p: smoothing.moving_majority(_half(p), 12).select("id_jugador", "frame", "majority")),
    "causal_hysteresis": over("positions")(lambda p: smoothing.causal_hysteresis(_half(p), 2).select("id_jugador", "frame", "held")),
    "impossible_runs": over("positions")(lambda p: islands.fast_runs(p, 2.0, 0.3).select("id_jugador", "start_frame", "end_frame")),
    "speed_cut": over("positions")(_cut_pieces),
    "replay_credible": over("positions")(lambda p: filters.credible(_half(p), 0.13, 2.0).select("frame", "id_jugador")),
    "active_identities": over("positions")(lambda p: tracking.concurrency(p, p)),
}

_BIN9 = "case when frame % 7 = 0 then x_m + 9e0 else x_m end"
ORACLES: dict[str, str] = {
    "collective_summary": _summary_sql(""),
    "collective_by_team": _summary_sql("equipo"),
    "heatmap_16x10": sql("positions", f"select cx, cy, count(*) as n from (select cast(least(trunc(x_m/100e0*16), 15) as int) as cx, cast(least(trunc(y_m/64e0*10), 9) as int) as cy from {_TEAM}) where cx >= 0 and cy >= 0 group by 1, 2"),
    "orientation": sql("positions", "select equipo, case when median(x_m) < 50e0 then 0e0 else 100e0 end as own_goal_x from positions where equipo in (0,1) and etiqueta like 'portero%' group by 1"),
    "lines_per_frame": sql("positions", _LINES + " select * from lines"),
    "team_line_metrics": sql("positions", _LINES + f" select equipo, {R('avg(defence_m)', 5)} as defence_m, {R('avg(block_m)', 5)} as block_m, {R('avg(attack_m - defence_m)', 5)} as between_m, count(*) as frames from lines group by 1"),
    "relative_thirds_lanes": sql("positions", _HEIGHT + " select equipo, " + ", ".join(f"{R(f'100e0 * sum(case when {c} then 1 else 0 end) / count(*)')} as {n}" for n, c in (("own_third", "height < 100e0/3"), ("middle_third", "height >= 100e0/3 and height < 200e0/3"), ("far_third", "height >= 200e0/3"), ("near_lane", "y_m < 64e0/3"), ("central_lane", "y_m >= 64e0/3 and y_m < 128e0/3"), ("far_lane", "y_m >= 128e0/3"))) + " from h group by 1"),
    "lateral_summary": sql("positions", f", m as (select equipo, tiempo_s, {R('avg(y_m)')} as y from positions where equipo in (0,1) and etiqueta not like 'portero%' group by 1, 2), s as (select equipo, tiempo_s, {R('avg(y) over (partition by equipo order by tiempo_s rows between 8 preceding and 7 following)', 5)} as shift_m from m) select equipo, {R('avg(shift_m)', 1)} as shift_m_mean, {R('min(shift_m)', 1)} as shift_m_min, {R('max(shift_m)', 1)} as shift_m_max from s group by 1"),
    "lateral_shift": sql("positions", f", m as (select equipo, tiempo_s, {R('avg(y_m)')} as y from positions where equipo in (0,1) and etiqueta not like 'portero%' group by 1, 2) select equipo, tiempo_s, {R('avg(y) over (partition by equipo order by tiempo_s rows between 8 preceding and 7 following)', 5)} as shift_m from m"),
    "block_metrics": sql("positions", _blocks()),
    "headcount_pivot": sql("positions detections", ", c as (select frame, count(case when equipo = 0 then 1 end) as a, count(case when equipo = 1 then 1 end) as b, count(case when equipo = 2 then 1 end) as other from positions group by 1) select f.frame, coalesce(a, 0) as a, coalesce(b, 0) as b, coalesce(other, 0) as other from (select distinct frame from detections) f left join c using (frame)"),
    "cardinality_violations": sql("positions detections", f", c as (select frame, count(*) as n from positions where equipo = 2 and x_m between 0 and 100 and y_m between 0 and 64 group by 1) select count(*) as frames, count(case when n > 0 then 1 end) as over, {R('100e0 * count(case when n > 0 then 1 end) / count(*)')} as over_pct from (select distinct frame from detections) f left join c using (frame)"),
    "drift_by_segment": sql("positions", f", b as ({_blocks()}), t as (select b.*, tiempo_s from b join (select distinct frame, tiempo_s from positions) using (frame)) select equipo, cast(floor(tiempo_s / 10e0) as int) as segment, {R('median(cx)')} as cx, {R('median(cy)')} as cy, {R('median(width_m)')} as width_m, {R('median(depth_m)')} as depth_m, count(*) as frames from t group by 1, 2"),
    "episodes_15s": sql("positions", f", c as (select frame, tiempo_s, count(*) as n from {_TEAM} group by 1, 2), e as (select cast(floor(tiempo_s / 15e0) as int) as episode, count(*) as frames, {R('avg(n)')} as mean_n from c group by 1) select *, case when mean_n >= 20 then 'good' when mean_n >= 17 then 'medium' else 'bad' end as grade from e"),
    "sliding_30s_windows": sql("positions", f", e as (select frame, unnest(generate_series(greatest(cast(floor((tiempo_s - 30) / 5) as bigint) + 1, 0), cast(floor(tiempo_s / 5) as bigint))) as w from {_TEAM}) select w * 5 as start_s, count(*) as n, count(distinct frame) as frames from e group by 1"),
    "funnel": sql("detections positions", f"select '1 detections' as stage, count(*) as n from detections union all select '2 rows', count(*) from positions union all select '3 of teams', count(*) from {_TEAM} union all select '4 measured', count(*) from {_TEAM} and es_real = 1 union all select '5 on pitch', count(*) from {_TEAM} and es_real = 1 and x_m between 0 and 100 and y_m between 0 and 64"),
    "team_flip_runs": sql("positions", """, s as (select *, case when (frame / 3e0 + id_jugador) % 11 < 3 then 'x' else etiqueta end as label, sum(case when d > 0.5e0 then 1 else 0 end) over (partition by id_jugador order by frame) as seg from (select *, tiempo_s - lag(tiempo_s) over (partition by id_jugador order by frame) as d from positions)),
 c as (select *, case when label = lag(label) over (partition by id_jugador, seg order by frame) then 0 else 1 end as ch from s), r as (select *, sum(ch) over (partition by id_jugador, seg order by frame) as run from c),
 b as (select id_jugador, seg, run, min(label) as label, count(*) as n from r group by 1, 2, 3) select label, count(*) as runs, cast(sum(n) as bigint) as n, max(n) as longest from b group by 1"""),
    "jump_events": sql("positions", SPEEDS + " select id_jugador, frame, prev_frame from speeds where step_m > 1e0 and dt <= 0.35e0"),
    "reentries": sql("positions", SPEEDS + " select id_jugador, frame, prev_frame from speeds where dt >= 0.2e0"),
    "tactical_lines": sql("positions", "select frame, equipo, min(x_m) as low_x, max(x_m) as high_x, min(y_m) as low_y, max(y_m) as high_y, count(*) as n from positions where equipo in (0,1) and etiqueta not like 'portero%' group by 1, 2"),
    "densest_window": sql("positions", ", o as (select frame, case when count(case when equipo = 0 then 1 end) >= 7 and count(case when equipo = 1 then 1 end) >= 7 then 1 else 0 end as ok from positions where equipo in (0,1) and etiqueta not like 'portero%' group by 1), w as (select frame, cast(sum(ok) over (order by frame rows between current row and 24 following) as bigint) as n from o) select frame as start_frame, n from w order by n desc, frame limit 1"),
    "deepest_n": sql("positions", _HEIGHT + f", t as (select * from (select *, row_number() over (partition by frame, equipo order by height, id_jugador) as r from h) where r <= 4) select frame, equipo, string_agg(cast(id_jugador as varchar), ',' order by y_m, id_jugador) as line, {R('avg(height)')} as height_m from t group by 1, 2 having count(*) = 4"),
    "fixed_bins": sql("positions", "select case when x_m > 0 and x_m <= 25 then 0 when x_m > 25 and x_m <= 50 then 1 when x_m > 50 and x_m <= 75 then 2 when x_m > 75 and x_m <= 100 then 3 end as bin, count(*) as n from positions group by 1"),
    "quantile_bins": sql("positions", ", e as (select quantile_cont(x_m, 1e0/3) as a, quantile_cont(x_m, 2e0/3) as b from positions) select cast(case when a < x_m then 1 else 0 end + case when b < x_m then 1 else 0 end as int) as bin, count(*) as n from positions, e group by 1"),
    "label_mode": sql("positions", "select id_jugador, etiqueta, n from (select id_jugador, etiqueta, count(*) as n, row_number() over (partition by id_jugador order by count(*) desc, etiqueta) as r from positions group by 1, 2) where r = 1"),
    "distance_run": sql("positions", SPEEDS + f" select id_jugador, {R('sum(step_m)')} as run_m, {R('max(speed)')} as top_speed, count(*) as steps from speeds group by 1"),
    "product_error_vs_gt": sql("gt_obs positions", _GT_ROWS + f", a as ({_blocks('gt')}), b as ({_blocks()}) select b.equipo, count(*) as n, {R('median(sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)))')} as centroid_m, {R('median(abs(b.width_m-a.width_m))')} as width_m, {R('median(abs(b.depth_m-a.depth_m))')} as depth_m from a join b using (frame, equipo) group by 1"),
    "occupancy_error": sql("gt_obs positions", _GT_ROWS + "".join(f", {n} as (select equipo, zx, zy, count(*) * 1e0 / sum(count(*)) over (partition by equipo) as s from (select equipo, least(greatest(floor(x_m * 3 / 100e0), 0), 2) as zx, least(greatest(floor(y_m * 3 / 64e0), 0), 2) as zy from {t} where equipo in (0, 1)) group by 1, 2, 3)" for n, t in (("a", "gt"), ("b", "positions"))) + f" select equipo, {R('50e0 * sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0)))')} as occupancy_pct from a full join b using (equipo, zx, zy) group by 1"),
    "bin_proxies": sql("positions", ", moved as (select * replace (" + _BIN9 + " as x_m) from positions)" + SPEEDS.replace("from positions", "from moved") + f", c as (select frame, tiempo_s, count(*) as n from {_TEAM} group by 1, 2), d as (select cast(floor(tiempo_s / 15e0) as int) as bin, avg(greatest(22 - n, 0)) as deficit, count(*) as frames from c group by 1), j as (select cast(floor(tiempo_s / 15e0) as int) as bin, count(*) as jumps from speeds where step_m > 3 group by 1), b as (select * from d join j using (bin)) select bin, frames, jumps, {R('deficit')} as deficit, {R('(deficit - (select avg(deficit) from b)) / (select stddev_samp(deficit) from b)', 5)} as z from b"),
    "weighted_quantile": sql("positions", ", b as (select x_m, sum(id_jugador) as w from positions group by 1), r as (select x_m, sum(w) over (order by x_m) as below from b) select min(x_m) as value from r where below >= 0.5e0 * (select sum(w) from b)"),
    "showable": sql("positions", SPEEDS + " select count(step_m) as n, median(step_m) <= 1e0 and quantile_cont(step_m, 0.9e0) <= 3e0 and count(step_m) >= 30 as show from speeds"),
    "gap_fill_linear": sql("positions", _HALF + f""", re as (select id_jugador, frame, tiempo_s, x_m, y_m, lead(frame) over w as nf, lead(tiempo_s) over w as nt, lead(x_m) over w as nx, lead(y_m) over w as ny from hr where es_real = 1 window w as (partition by id_jugador order by frame)),
 f as (select distinct frame as ff, tiempo_s as ft from positions)
 select id_jugador, frame, {R('x_m')} as x_m, {R('y_m')} as y_m, 1 as es_real from re
 union all select id_jugador, ff, {R('x_m + (ft - tiempo_s) / (nt - tiempo_s) * (nx - x_m)')}, {R('y_m + (ft - tiempo_s) / (nt - tiempo_s) * (ny - y_m)')}, 0 from re join f on ff > frame and ff < nf where nt - tiempo_s <= 0.5e0"""),
    "moving_average_edge": _moving_sql(),
    "savgol_interior": _savgol_sql(),
    "smooth_in_time": sql("positions", f"select id_jugador, frame, {R('avg(x_m) over w', 5)} as sx, {R('avg(y_m) over w', 5)} as sy from positions window w as (partition by id_jugador order by frame range between 9 preceding and 9 following)"),
    "smooth_in_segments": sql("positions", SPEEDS + f", g as (select *, sum(case when step_m > 2.5e0 * (tiempo_s - prev_t) then 1 else 0 end) over (partition by id_jugador order by frame) as seg from (select s.*, sqrt((x_m-prev_x)*(x_m-prev_x) + (y_m-prev_y)*(y_m-prev_y)) as step_m from steps s)) select id_jugador, frame, {R('avg(x_m) over w', 5)} as sx, {R('avg(y_m) over w', 5)} as sy from g window w as (partition by id_jugador, seg order by frame range between 9 preceding and 9 following)"),
    "jitter_sigma": sql("positions", f", s as (select y_m, frame - lag(frame) over w as a, lead(frame) over w - frame as b, lag(x_m) over w - 2 * x_m + lead(x_m) over w as d from positions window w as (partition by id_jugador order by frame)), t as (select cast(floor(y_m / 16e0) as int) as band, d from s where a = 3 and b = 3), m as (select band, median(d) as m, count(*) as n from t group by 1) select band, n, {R('1.4826e0 * median(abs(d - m)) / sqrt(6e0)')} as sigma_m from t join m using (band) group by 1, 2"),
    "label_propagation": sql("positions", _HALF + """, n as (select *, last_value(case when es_real = 1 then frame end ignore nulls) over a as pf, last_value(case when es_real = 1 then etiqueta end ignore nulls) over a as pl, first_value(case when es_real = 1 then frame end ignore nulls) over b as nf, first_value(case when es_real = 1 then etiqueta end ignore nulls) over b as nl from hr
 window a as (partition by id_jugador order by frame rows between unbounded preceding and current row), b as (partition by id_jugador order by frame rows between current row and unbounded following))
 select id_jugador, frame, case when es_real = 1 then etiqueta when pf is not null and (nf is null or frame - pf <= nf - frame) then pl else nl end as label from n"""),
    "visual_median": sql("positions", _HALF + """, a as (select *, lag(etiqueta) over w as p, lead(etiqueta) over w as n, count(*) over (partition by id_jugador) as c from hr window w as (partition by id_jugador order by frame))
 select id_jugador, frame, case when c < 3 then etiqueta when p is not null and n is not null and p = n then p else etiqueta end as shown from a"""),
    "visual_hysteresis": sql("positions", _HALF + """, d as (select *, tiempo_s - lag(tiempo_s) over w as dt, case when etiqueta = lag(etiqueta) over w then 0 else 1 end as ch from hr window w as (partition by id_jugador order by frame)),
 st as (select id_jugador, median(dt) as step, max(tiempo_s) as last from d group by 1), r as (select *, sum(ch) over (partition by id_jugador order by frame) as run from d),
 b as (select id_jugador, run, min(tiempo_s) as start, min(etiqueta) as value from r group by 1, 2), e as (select b.*, coalesce(lead(start) over (partition by id_jugador order by run), last + coalesce(step, 0)) as fin from b join st using (id_jugador)),
 k as (select id_jugador, run, last_value(case when run = 1 or fin - start >= 0.3e0 - 1e-9 then value end ignore nulls) over (partition by id_jugador order by run rows between unbounded preceding and current row) as shown from e)
 select id_jugador, frame, shown from r join k using (id_jugador, run)"""),
    "moving_majority": sql("positions", _HALF + ", p as (select a.id_jugador, a.frame, b.etiqueta, count(*) as n from hr a join hr b on a.id_jugador = b.id_jugador and b.frame between a.frame - 12 and a.frame + 12 group by 1, 2, 3) select id_jugador, frame, etiqueta as majority from (select *, row_number() over (partition by id_jugador, frame order by n desc, etiqueta) as r from p) where r = 1"),
    "causal_hysteresis": sql("positions", _HALF + ", c as (select *, case when etiqueta = lag(etiqueta) over (partition by id_jugador order by frame) then 0 else 1 end as ch from hr), r as (select *, sum(ch) over (partition by id_jugador order by frame) as run from c), k as (select *, row_number() over (partition by id_jugador, run order by frame) as k from r) select id_jugador, frame, last_value(case when k >= 2 or run = 1 then etiqueta end ignore nulls) over (partition by id_jugador order by frame rows between unbounded preceding and current row) as held from k"),
    "impossible_runs": sql("positions", SPEEDS + ", c as (select *, speed > 2e0 as fast, case when (speed > 2e0) = lag(speed > 2e0) over (partition by id_jugador order by frame) then 0 else 1 end as ch from speeds), r as (select *, sum(ch) over (partition by id_jugador order by frame) as run from c) select id_jugador, min(prev_frame) as start_frame, max(frame) as end_frame from r where fast group by id_jugador, run having max(tiempo_s) - min(prev_t) >= 0.3e0"),
    "replay_credible": sql("positions", _HALF + """, a as (select *, max(case when es_real = 1 then tiempo_s end) over (partition by id_jugador) - min(case when es_real = 1 then tiempo_s end) over (partition by id_jugador) as life,
 tiempo_s - last_value(case when es_real = 1 then tiempo_s end ignore nulls) over (partition by id_jugador order by tiempo_s rows between unbounded preceding and current row) as b, first_value(case when es_real = 1 then tiempo_s end ignore nulls) over (partition by id_jugador order by tiempo_s rows between current row and unbounded following) - tiempo_s as c from hr)
 select frame, id_jugador from a where life >= 2e0 and (es_real = 1 or least(coalesce(b, 1e9), coalesce(c, 1e9)) <= 0.13e0)"""),
    "active_identities": sql("positions", ", l as (select id_jugador, min(frame) as a, max(frame) as b from positions group by 1) select f.frame, count(l.id_jugador) as active from (select distinct frame from positions) f left join l on f.frame between a and b group by 1"),
}
