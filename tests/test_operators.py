"""Toy inputs with known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake import functions as fn
from pitchlake import sources
from pitchlake.operators import ball, evaluation, filters, islands, matching, metrics, pitch, smoothing, teams, tracking

POS = "frame int, tiempo_s double, id_jugador int, equipo int, etiqueta string, x_m double, y_m double, es_real int"


def positions(spark, rows):
    return spark.createDataFrame([(f, f / 25, i, e, l, float(x), float(y), r) for f, i, e, l, x, y, r in rows], POS)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_a_long_chain_of_mark_cells_is_one_mark(spark):
    rows = [(f, f * 1.0, 12.0 * f2 + 6, 12.0 * (f2 % 2) + 6) for f2 in range(60) for f in range(4)]
    cands = spark.createDataFrame(rows, "frame int, t double, px double, py double")
    got = ball.static_marks(cands, least=4, least_span_s=3.0).collect()
    assert len(got) == 60
    assert {r["mark"] for r in got} == {0}


@pytest.mark.parametrize(("seen", "cells"), [((4, 8), {(0, 0), (1, 1)}), ((3, 4), set())])
def test_minutes_of_a_mark_are_those_of_all_its_cells(spark, seen, cells):
    """A mark on the edge of two cells, in the one up to a minute, then in the other; ten minutes in all."""
    rows = [(f, 60.0 * m + f, 11.0 + 2 * (m >= seen[0]), 11.0 + 2 * (m >= seen[0])) for m in range(seen[1]) for f in range(4)] + [(0, 60.0 * m, 200.0 + 40 * m, 6.0) for m in range(10)]
    cands = spark.createDataFrame(rows, "frame int, t double, px double, py double")
    got = ball.static_marks(cands, least=4, least_span_s=3.0)
    assert {(r["cx"], r["cy"]) for r in got.collect()} == cells
    assert ball.without_marks(cands, got).count() == len(rows) - (32 if cells else 0)


@pytest.mark.parametrize("gap", [1, 5])
def test_no_window_up_to_the_end_of_an_identity(spark, gap):
    """Such a window reads the rest of the identity for each row: time grows with the square of its rows."""
    n = 1000
    rows = spark.range(n).select(F.col("id").cast("int").alias("frame"), (F.col("id") / 25).alias("tiempo_s"), F.lit(1).alias("id_jugador"), F.lit("A").alias("etiqueta"), F.when(F.col("id").isin(0, n - gap), 1).otherwise(0).alias("es_real"))
    track = rows.select("frame", F.col("tiempo_s").alias("t"), F.col("frame").cast("double").alias("mx"), F.lit(0.0).alias("my"), (F.col("es_real") == 0).alias("aerial"))
    labels, shown, lines = smoothing.spread_labels(rows), filters.credible(rows, 0.13, 2.0), ball.flight_lines(track.withColumn("mx", F.when(F.col("aerial"), 7.0).otherwise(F.col("mx"))))
    for got in (labels, shown, lines):
        assert "currentrow$(), unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    assert labels.where("label = 'A'").count() == n
    assert shown.count() == 8 + min(gap - 1, 3)
    assert lines.where((F.abs(F.col("fx") - F.col("frame")) < 1e-6) | (F.col("frame") > n - gap)).count() == n


def test_equal_deficits_have_no_z_score(spark):
    rows = [(f, i, 0, "A", 10.0 + (5 if f == 3 + 375 * k else 0), 1.0, 1) for k in range(2) for f in range(375 * k, 375 * k + 9, 3) for i in (1, 2)]
    got = metrics.bin_proxies(positions(spark, rows)).collect()
    assert [(r["bin"], r["deficit"], r["z"]) for r in sorted(got, key=lambda r: r["bin"])] == [(0, 20.0, None), (1, 20.0, None)]


# assignment


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 5), rng.integers(1, 6)
    cost = rng.random((n, m))
    r, c = matching.assign(cost)
    assert len(r) == min(n, m) == len(set(r)) == len(set(c))
    small, large = (cost, m) if n <= m else (cost.T, n)
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), len(small)))
    assert cost[r, c].sum() == pytest.approx(best)


def test_assignment_of_nothing():
    assert len(matching.assign(np.zeros((0, 3)))[0]) == 0


def gt(spark, rows):
    return spark.createDataFrame([(f, i, float(x), float(y), t, "player") for f, i, x, y, t in rows], "frame int, obj_id int, x_m double, y_m double, team string, label string")


def two_players(spark, swap=False):
    truth = [(f, i, 10 + 20 * i, 10 + 20 * i, "AB"[i]) for f in range(10) for i in (0, 1)]
    pred = [(f, (i if f < 5 or not swap else 1 - i), x, y, t) for f, i, x, y, t in truth]
    return gt(spark, truth), gt(spark, pred)


def test_perfect_tracking(spark):
    g, p = two_players(spark)
    pairs = matching.optimal_then_threshold(g, p)
    s = evaluation.identity_scores(g, p, pairs).first()
    assert s["idf1"] == 1.0 and s["recall"] == 1.0
    assert {r["switches"] for r in evaluation.switches(g, pairs).collect()} == {0}
    assert evaluation.hota(g, p).agg(F.min("hota")).first()[0] == pytest.approx(1.0)


def test_swap_in_the_middle(spark):
    g, p = two_players(spark, swap=True)
    pairs = matching.optimal_then_threshold(g, p)
    assert evaluation.identity_scores(g, p, pairs).first()["idf1"] == 0.5
    assert [r["switches"] for r in evaluation.switches(g, pairs).collect()] == [1, 1]
    assert evaluation.team_crossings(pairs, g).collect()[0]["kind"] == "cross"


def test_threshold_before_and_after_differ(spark):
    g = gt(spark, [(0, 1, 0, 0, "A"), (0, 2, 3, 0, "A")])
    p = gt(spark, [(0, 7, 1.8, 0, "A"), (0, 8, 20, 0, "A")])
    after = matching.optimal_then_threshold(g, p, 2.0).collect()
    before = matching.threshold_then_optimal(g, p, 2.0).collect()
    assert {(r["gt_id"], r["pred_id"]) for r in before} == {(2, 7)}
    assert {(r["gt_id"], r["pred_id"]) for r in after} in ({(1, 7)}, {(2, 7)})
    assert {(r["gt_id"], r["pred_id"]) for r in matching.greedy_in_order(g, p).collect()} == {(2, 7)}


def test_shapley_shares_add_up(spark):
    each = spark.createDataFrame([(1.0, 2.0, 0.5, 0.0, 0.25)] * 3, ", ".join(f"{k} double" for k in evaluation.FIXES))
    shares = {r["kind"]: r["share"] for r in evaluation.shapley(evaluation.error_ladder(each)).collect()}
    assert shares == {"position": 1.0, "missing": 2.0, "phantom": 0.5, "team": 0.0, "duplicate": 0.25}


# geometry


def test_scales_of_a_plain_homography(spark):
    h = [[0.1, 0.0, 0.0], [0.0, 0.3, 0.0], [0.0, 0.0, 1.0]]
    r = one(spark, *fn.ground_scales(F.lit(5.0), F.lit(7.0), h))
    assert r[0] == pytest.approx(0.1) and r[1] == pytest.approx(0.3)


def test_scales_by_svd(spark):
    h = np.array([[0.05, 0.002, -3.0], [0.001, 0.09, -12.0], [0.00001, 0.0004, 1.0]])
    f = lambda u, v: (lambda p: p[:2] / p[2])(h @ np.array([u, v, 1.0]))
    e = 1e-4
    jac = np.column_stack([(f(800 + e, 400) - f(800 - e, 400)) / (2 * e), (f(800, 400 + e) - f(800, 400 - e)) / (2 * e)])
    got = one(spark, *fn.ground_scales(F.lit(800.0), F.lit(400.0), h.tolist()))
    assert sorted(got) == pytest.approx(sorted(np.linalg.svd(jac)[1]), rel=1e-5)


def test_horizon_has_no_scale(spark):
    assert one(spark, fn.ground_scales(F.lit(1.0), F.lit(-1.0), [[1, 0, 0], [0, 1, 0], [0, 1, 1]])[0])[0] is None


def test_polygon_and_edges(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    r = one(spark, fn.in_polygon(F.lit(5.0), F.lit(5.0), square), fn.in_polygon(F.lit(15.0), F.lit(5.0), square), fn.edge_distance(F.lit(5.0), F.lit(-2.0), 10.0, 10.0), fn.edge_distance(F.lit(5.0), F.lit(3.0), 10.0, 10.0))
    assert list(r) == [True, False, 2.0, -3.0]


def test_wilson(spark):
    r = one(spark, fn.wilson_lower(F.lit(0), F.lit(0)), fn.wilson_lower(F.lit(8), F.lit(10)))
    assert r[0] == 0.0 and r[1] == pytest.approx(0.4902, abs=1e-3)


def test_iou(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, fn.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)))[0] == pytest.approx(1 / 3)
    assert one(spark, fn.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)))[0] == 0.0


def test_mixed_cost_beyond_reach(spark):
    r = one(spark, fn.mixed_cost(F.lit(50.0), F.lit(0.12), F.lit(10.0)), fn.mixed_cost(F.lit(0.5), F.lit(0.12), F.lit(10.0)))
    assert r[0] == math.inf and 0 < r[1] < 1


def test_savitzky_golay_keeps_parabolas():
    w = fn.savitzky_golay_weights(7)
    assert sum(w) == pytest.approx(1) and sum(x * k * k for x, k in zip(w, range(-3, 4), strict=True)) == pytest.approx(0)


def test_resolution_is_one_for_a_scale(spark):
    h = [[0.05, 0.0, 0.0], [0.0, 0.05, 0.0], [0.0, 0.0, 1.0]]
    r = pitch.resolution_grid(spark, h, pitch.Pitch()).agg(F.min("mpp"), F.max("factor"), F.count("*")).first()
    assert r[0] == pytest.approx(0.05) and r[1] == pytest.approx(1.0) and r[2] == 51 * 33


# interpolation and smoothing


def test_gap_fill(spark):
    rows = positions(spark, [(f, 1, 0, "A", 5 * f / 25, 1, 1) for f in (0, 3, 15, 18)])
    frames = spark.createDataFrame([(f, f / 25) for f in range(0, 21, 3)], "frame int, tiempo_s double")
    got = {r["frame"]: (round(r["x_m"], 6), r["es_real"]) for r in smoothing.fill_gaps(rows, frames, 1.0).collect()}
    assert {f: got[f] for f in (6, 9, 12)} == {6: (1.2, 0), 9: (1.8, 0), 12: (2.4, 0)}
    assert len(got) == 7


def test_no_fill_outside_or_too_long(spark):
    rows = positions(spark, [(6, 1, 0, "A", 0, 0, 1), (33, 1, 0, "A", 9, 0, 1)])
    frames = spark.createDataFrame([(f, f / 25) for f in range(0, 60, 3)], "frame int, tiempo_s double")
    assert smoothing.fill_gaps(rows, frames, 0.5).count() == 2


def test_average_pads_with_the_ends(spark):
    rows = positions(spark, [(3 * i, 1, 0, "A", x, 0, 1) for i, x in enumerate((0, 10, 20, 30, 40))])
    got = [r["sx"] for r in smoothing.moving_average(rows, 3).orderBy("frame").collect()]
    assert got == pytest.approx([10 / 3, 10, 20, 30, 110 / 3])


def test_hysteresis_paints_long_runs_from_their_start(spark):
    rows = positions(spark, [(25 * i, 1, 0, t, 0, 0, 1) for i, t in enumerate("AAABAAABBBB")])
    got = "".join(r["shown"] for r in smoothing.visual_hysteresis(rows, 2.0).orderBy("frame").collect())
    assert got == "AAAAAAABBBB"


def test_visual_median_removes_single_flicker(spark):
    rows = positions(spark, [(i, 1, 0, t, 0, 0, 1) for i, t in enumerate("AABAABBAA")])
    assert "".join(r["shown"] for r in smoothing.visual_median(rows).orderBy("frame").collect()) == "AAAAABBAA"


def test_jump_is_cut_out(spark):
    rows = positions(spark, [(3 * i, 1, 0, "A", (0 if i < 4 else 50) + 0.1 * i, 0, 1) for i in range(8)])
    got = smoothing.cut_by_speed(rows)
    assert sorted(r["count"] for r in got.groupBy("piece").count().collect()) == [4, 4]


def test_fast_run_is_cut_out(spark):
    xs = [0, 0.1, 0.2, 0.3] + [0.3 + 1.2 * k for k in range(1, 7)] + [7.6, 7.7, 7.8]
    rows = positions(spark, [(3 * i, 1, 0, "A", x, 0, 1) for i, x in enumerate(xs)])
    pieces = {r["piece"]: r["n"] for r in smoothing.cut_by_speed(rows).groupBy("piece").agg(F.count("*").alias("n")).collect()}
    assert sorted(pieces.values()) == [4, 4]


# metrics and filters


def report(spark):
    rows = []
    for f in range(10):
        rows += [(f, 1, 0, "portero_A", 95, 32, 1), (f, 6, 1, "portero_B", 10, 32, 1)]
        rows += [(f, 2 + k, 0, "A", x, 10 + k, 1) for k, x in enumerate((85, 83, 60, 58, 40, 38, 30))]
        rows += [(f, 20 + k, 1, "B", x, 10 + k, 1) for k, x in enumerate((20, 22, 40, 42, 60, 62, 70))]
    return positions(spark, rows)


def test_lines(spark):
    r = {x["equipo"]: x for x in metrics.lines(report(spark), length=105.0).where("frame = 0").collect()}
    assert r[0]["defence_m"] == pytest.approx(105 - (85 + 83 + 60 + 58) / 4) and r[0]["attack_m"] == pytest.approx(105 - 36)
    assert r[1]["defence_m"] == pytest.approx((20 + 22 + 40 + 42) / 4)


def test_thin_frames_have_no_lines(spark):
    assert metrics.lines(report(spark).where("id_jugador not in (3, 4)")).where("equipo = 0").count() == 0


def test_heatmap_cuts_towards_zero(spark):
    rows = positions(spark, [(0, 1, 0, "A", -0.5, 0.1, 1), (0, 2, 0, "A", 100.0, 64.0, 1), (0, 3, 2, "otro", 5, 5, 1)])
    assert {(r["cx"], r["cy"]) for r in metrics.heatmap(rows).collect()} == {(0, 0), (15, 9)}


def test_credible_rows(spark):
    rows = [(25 * i, 1, 0, "A", 0, 0, 1) for i in range(4)] + [(87, 1, 0, "A", 0, 0, 0), (20, 2, 0, "A", 0, 0, 1), (0, 9, 3, "balon", 0, 0, 0)]
    got = {(r["frame"], r["id_jugador"]) for r in filters.credible(positions(spark, rows)).collect()}
    assert (87, 1) in got and (20, 2) not in got and (0, 9) in got


def test_time_join_takes_the_earlier_of_two(spark):
    a = spark.createDataFrame([(1.0,), (5.0,)], "t double")
    b = spark.createDataFrame([(0.9, 1), (1.1, 2)], "t double, v int")
    assert [(r["t"], r["r_v"]) for r in islands.nearest_in_time(a, b, 0.2).orderBy("t").collect()] == [(1.0, 1), (5.0, None)]


def test_holes(spark):
    f = spark.createDataFrame([(0,), (3,), (12,)], "frame int")
    assert [tuple(r) for r in islands.coverage_holes(f, 3).collect()] == [(3, 12, 2)]


def test_empty_positions(spark):
    none = positions(spark, [])
    for f in (metrics.lines, metrics.heatmap, metrics.territory, smoothing.visual_hysteresis, smoothing.spread_labels, teams.staff, islands.fast_runs):
        assert f(none).count() == 0


# tracking


def detections(spark, rows):
    return spark.createDataFrame([(f, f / 25, i, float(x), float(y), 0.0, 0.0, 1.0, 2.0, 0.9) for f, i, x, y in rows], "frame int, t double, det_idx int, mx double, my double, x1 double, y1 double, x2 double, y2 double, conf double")


def test_straight_runner_is_one_tracklet(spark):
    got = tracking.conservative_tracker(detections(spark, [(3 * i, 0, 0.6 * i, 5) for i in range(8)]), 0.12)
    assert got.select("tracklet_id").distinct().count() == 1 and got.count() == 8


def test_close_pair_is_not_swapped(spark):
    got = tracking.conservative_tracker(detections(spark, [(3 * i, k, 10 + (0.5 * i if k else -0.5 * i), 5 + 0.2 * k) for i in range(-6, 7) for k in (0, 1)]), 0.12)
    sides = got.groupBy("tracklet_id").agg(F.countDistinct("det_idx").alias("n"))
    assert sides.agg(F.max("n")).first()[0] == 1


def tracklets(spark, rows):
    return spark.createDataFrame([(i, a, b, float(x0), 0.0, float(x1), 0.0, 0.0, 0.0, 5) for i, a, b, x0, x1 in rows], "tracklet_id int, t0 double, t1 double, x0 double, y0 double, x1 double, y1 double, vx double, vy double, n int")


def test_stitching(spark):
    t = tracklets(spark, [(1, 0.0, 1.0, 0, 5), (2, 2.0, 3.0, 5, 8), (3, 2.0, 3.0, 90, 95), (4, 20.0, 21.0, 8, 9)])
    c = tracking.stitch_candidates(t)
    assert {(r["a"], r["b"]) for r in c.collect()} == {(1, 2)}
    for how in ("greedy", "global"):
        assert {(r["a"], r["b"]) for r in tracking.choose_links(c, how).collect()} == {(1, 2)}


def test_global_choice_beats_greedy(spark):
    c = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.2), (2, 10, 0.3)], "a int, b int, cost double")
    assert tracking.choose_links(c, "greedy").count() == 1
    assert {(r["a"], r["b"]) for r in tracking.choose_links(c, "global").collect()} == {(1, 11), (2, 10)}


def test_links_make_identities(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "tracklet_id int")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "a int, b int")
    got = {r["tracklet_id"]: r["identity_id"] for r in tracking.components(nodes, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}


# teams and ball


def test_team_fit_finds_two_groups(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in np.eye(8)[k] + 0.01 * rng.standard_normal(8)],) for k in (0, 3) for _ in range(60)]
    f = spark.createDataFrame(rows, "feat array<double>")
    p = teams.fit_prototypes(f, k=4)
    assert {int(np.argmax(p.a)), int(np.argmax(p.b))} == {0, 3}
    assert teams.predict(f, p).groupBy("team").count().where("team in ('A', 'B')").count() == 2


def track(spark, rows):
    return spark.createDataFrame([(2 * i, 2 * i / 25, 0, float(x), float(y), float(x), float(y), 10.0, 0.9) for i, (x, y) in enumerate(rows)], "frame int, t double, cand_idx int, mx double, my double, px double, py double, h_px double, conf double")


def test_sharp_turn_is_a_contact(spark):
    t = track(spark, [(0, 30), (1, 30), (2, 30), (3, 30), (3, 31), (3, 32), (3, 33)])
    people = positions(spark, [(6, 4, 0, "A", 3.5, 30, 1), (6, 5, 1, "B", 9, 30, 1)])
    got = ball.contacts_by_angle(t, people).collect()
    assert [(r["frame"], r["id_jugador"]) for r in got] == [(6, 4)] and got[0]["angle"] == pytest.approx(90)


def test_path_prefers_a_lasting_object(spark):
    rows = [(2 * i, 2 * i / 25, c, 0.0, 0.0, float(x), 0.0, 8.0, 0.9) for i in range(10) for c, x in (((0, 900), (1, 100 + i)) if i == 5 else ((0, 100 + i),))]
    c = spark.createDataFrame(rows, "frame int, t double, cand_idx int, mx double, my double, px double, py double, h_px double, conf double")
    assert ball.best_path(c).where("px > 500").count() == 0 and ball.best_path(c).count() == 10


def test_flight_is_a_line_in_time(spark):
    t = track(spark, [(0, 0), (5, 9), (6, 9), (9, 0)]).withColumn("aerial", F.col("frame").isin(2, 4))
    got = [r["fx"] for r in ball.flight_lines(t).orderBy("frame").collect()]
    assert got == pytest.approx([0, 3, 6, 9])


# sources


def test_cache_rules(spark):
    good = detections(spark, [(3 * i, 0, 30, 20) for i in range(20)])
    frames = good.select("frame").distinct().withColumn("seq", F.col("frame"))
    assert sources.content_violations(good, frames, 3).count() == 0
    rules = lambda d, f=frames, s=3: {r["rule"] for r in sources.content_violations(d, f, s).collect()}
    assert rules(good.withColumn("mx", F.col("mx") * 20)) == {"mx in metres"}
    assert rules(good.withColumn("conf", F.lit(1.5))) == {"confidence"}
    assert rules(good.withColumn("x2", F.lit(-1.0))) == {"upright boxes"}
    assert rules(good.where("frame = 0")) == {"mostly empty"} or rules(good.limit(0)) == {"mostly empty"}
    assert rules(good, frames.where("frame < 20 or frame > 40")) == {"long gap"}
    assert "frames grow" in rules(good, frames.withColumn("seq", -F.col("frame")))
    assert "steps fit the sample" in rules(good, frames, 2)


def test_merge_keeps_the_first_cache(spark):
    a, b = detections(spark, [(0, 0, 1, 1), (3, 0, 1, 1)]), detections(spark, [(3, 0, 2, 2), (6, 0, 2, 2)])
    assert {(r["frame"], r["mx"]) for r in sources.merge_caches([a, b]).collect()} == {(0, 1.0), (3, 1.0), (6, 2.0)}


def test_positions_round_trip(spark, tmp_path):
    rows = report(spark)
    s = sources.write_positions(rows, str(tmp_path / "p")).first()
    back = sources.read_positions(spark, str(tmp_path / "p"))
    assert s["rows"] == rows.count() and back.exceptAll(rows).count() == 0
    (tmp_path / "old.csv").write_text("frame,tiempo_s,id_jugador,equipo,x_m,y_m\n1,0.04,2,0,3.5,4\n")
    old = sources.read_positions(spark, str(tmp_path / "old.csv")).first()
    assert old["etiqueta"] is None and old["es_real"] == 1


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<annotations><track id="0" label="player"><box frame="0" xtl="1" ytl="2" xbr="3" ybr="4" outside="0"><attribute name="team">A</attribute></box>
<box frame="1" xtl="1" ytl="2" xbr="3" ybr="6" outside="0"></box><box frame="2" xtl="1" ytl="2" xbr="3" ybr="4" outside="1"></box></track></annotations>"""
    )
    got = sources.read_cvat(spark, str(tmp_path / "a.xml")).orderBy("frame").collect()
    assert [(r["frame"], r["team"]) for r in got] == [(0, "A"), (1, "A")]
    f = sources.feet(spark.createDataFrame(got), [[1, 0, 0], [0, 1, 0], [0, 0, 1]], 100, 5).orderBy("frame").collect()
    assert [(r["frame"], r["x_m"], r["y_m"]) for r in f] == [(100, 2.0, 4.0), (105, 2.0, 6.0)]


def test_cache_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"frame_idx": 3, "t": 0.12, "dets": [{"mx": 1, "my": 2, "x1": 0, "y1": 0, "x2": 1, "y2": 2, "conf": 0.5}]}\n')
    assert sources.flatten(sources.read_cache(spark, str(tmp_path / "c.json"), "json")).first()["mx"] == 1.0


def test_stream_matches_batch(spark, tmp_path):
    from pitchlake.streaming import track_stream

    d = detections(spark, [(3 * i, k, 0.6 * i + 30 * k, 5) for i in range(8) for k in (0, 1)]).withColumn("match_id", F.lit("m"))
    d.where("frame < 12").coalesce(1).write.parquet(str(tmp_path / "in"))
    d.where("frame >= 12").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = track_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), 0.12).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("tracked")
    assert got.count() == 16 and got.where("tracklet_id > 0").select("tracklet_id").distinct().count() == 2
