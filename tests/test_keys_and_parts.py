"""Two matches in one table give what each gives alone; operators of several parts against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import ball, evaluation, pitch, review, teams, tracking

POS = "match_no int, frame int, tiempo_s double, id_jugador int, equipo int, etiqueta string, x_m double, y_m double, es_real int"
BALL = "match_no int, frame int, t double, cand_idx int, mx double, my double, px double, py double, h_px double, conf double"


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(1)
    rows = [(m, 3 * k, 3 * k / 25, i, i % 3, "otro" if i % 3 == 2 else "AB"[i % 3], float(rng.uniform(0, 100)), float(rng.uniform(0, 64)), 1) for m in (1, 2) for k in range(60 + 20 * m) for i in range(1, 8) if rng.random() < 0.8]
    return spark.createDataFrame(rows, POS).cache()


@pytest.fixture(scope="module")
def track(spark):
    rng = np.random.default_rng(2)
    rows = []
    for m in (1, 2):
        at = np.array([50.0, 30.0])
        for k in range(150 + 30 * m):
            at = at + rng.normal(0, 1.5, 2)
            if rng.random() < 0.85:
                rows.append((m, 2 * k, 2 * k / 25, 0, *map(float, at), *map(float, at * 10), float(rng.uniform(8, 12)), float(rng.random())))
    return spark.createDataFrame(rows, BALL).cache()


def same(both, each, match):
    """Rows of ``both``, by match, are those of ``each`` of that match alone."""
    cols = [c for c in both.columns if c != "match_no"]
    got = sorted((tuple(r[c] for c in cols) for r in both.where(F.col("match_no") == match).collect()), key=repr)
    want = sorted((tuple(r[c] for c in cols) for r in each.collect()), key=repr)
    assert got == want and got


KEY = ["match_no"]
CASES = {
    "worst_windows": lambda p, b, k: review.worst_windows(p, 2, 5, 1, key=k),
    "play_score": lambda p, b, k: review.play_score(b, 5, 1, key=k),
    "smooth_ball": lambda p, b, k: review.smooth_ball(b.withColumn("aerial", F.col("frame") % 50 < 8), key=k),
    "readmitted_flights": lambda p, b, k: review.readmitted_flights(b.withColumn("aerial", F.col("frame") % 50 < 8), key=k),
    "aerial": lambda p, b, k: ball.aerial(b, key=k),
    "contacts_by_angle": lambda p, b, k: ball.contacts_by_angle(b, p, 40.0, 1.0, 30.0, key=k),
    "merge_contacts": lambda p, b, k: ball.merge_contacts(ball.contacts_by_angle(b, p, 40.0, 1.0, 30.0, key=k).select(*(k or []), "frame", "t", "mx", "my"), ball.acceleration_peaks(b, key=k[0] if k else None), key=k),
    "fill": lambda p, b, k: ball.fill(b, p.select(*(k or []), "frame", F.col("tiempo_s").alias("t")), line_s=9.0, line_v=99.0, line_x=0.0, key=k),
    "concurrency": lambda p, b, k: tracking.concurrency(p, p, match=k),
    "one_referee": lambda p, b, k: teams.one_referee(p, key=k),
    "keeper_set": lambda p, b, k: teams.keeper_set(p.select(*(k or []), "id_jugador").distinct().select("*", F.lit(0).alias("side"), F.lit(1.0).alias("score")), p, key=k),
    "capped_labels": lambda p, b, k: teams.capped_labels(p.select(*(k or []), "frame", "id_jugador", F.when(F.col("equipo") == 0, "A").when(F.col("equipo") == 1, "B").otherwise("otro").alias("team"), F.col("x_m").alias("score")), 1, key=k),
    "clear_mot": lambda p, b, k: evaluation.clear_mot(p.select(*(k or []), "frame", F.col("id_jugador").alias("obj_id"), "x_m", "y_m"), p.select(*(k or []), "frame", (F.col("id_jugador") + F.when(F.col("frame") > 90, 50).otherwise(0)).alias("obj_id"), (F.col("x_m") + 0.1).alias("x_m"), "y_m"), key=k),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_two_matches_in_one_table(people, track, name):
    both = CASES[name](people, track, KEY)
    for m in (1, 2):
        alone = [df.where(F.col("match_no") == m).drop("match_no") for df in (people, track)]
        same(both, CASES[name](*alone, None), m)


@pytest.mark.parametrize("seed", range(4))
def test_capped_labels_change_the_least(spark, seed):
    """Against all assignments of labels: within the numbers where places suffice, at the least total score of changed rows."""
    rng = np.random.default_rng(seed)
    rows = [(f, i, str(rng.choice(["A", "B", "otro"], p=[0.6, 0.25, 0.15])), float(rng.integers(1, 60))) for f in range(6) for i in range(int(rng.integers(3, 7)))]
    out = {(r["frame"], r["id_jugador"]): r["team"] for r in teams.capped_labels(spark.createDataFrame(rows, "frame int, id_jugador int, team string, score double"), 2, 1).collect()}
    assert len(out) == len(rows)
    for f in range(6):
        mine = [r for r in rows if r[0] == f]
        most = {"A": 2, "B": 2, "otro": 1}

        def price(labels, mine=mine, most=most):
            over = sum(max(0, labels.count(t) - n) for t, n in most.items())
            return over, sum(s for (_, _, t, s), x in zip(mine, labels, strict=True) if t != x)

        best = min(price(list(x)) for x in itertools.product(most, repeat=len(mine)))
        assert price([out[f, r[1]] for r in mine]) == pytest.approx(best)


def test_keeper_is_who_is_seen_most_and_its_continuations(spark):
    rows = [(0, f, f / 25, 1, 0, "A", 5.0, 30.0, 1) for f in range(0, 60)] + [(0, f, f / 25, 2, 0, "A", 5.5, 30.0, 1) for f in range(40, 60)]
    rows += [(0, f, f / 25, 3, 0, "A", 6.0, 31.0, 1) for f in range(60, 90)] + [(0, f, f / 25, 4, 1, "B", 95.0, 30.0, 1) for f in range(80, 90)]
    p = spark.createDataFrame(rows, POS).drop("match_no")
    scores = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.99), (0, 3, 0.8), (1, 4, 0.9)], "side int, id_jugador int, score double")
    got = sorted((r["side"], r["id_jugador"]) for r in teams.keeper_set(scores, p).collect())
    # 2 stands where 1 does; 4 covers too few frames of its side
    assert got == [(0, 1), (0, 3)]
    assert sorted(r["id_jugador"] for r in teams.keeper_set(scores, p, least_presence=0.1).collect()) == [1, 3, 4]


def test_clear_mot(spark):
    gt = [(f, i, 10.0 * i, 5.0) for f in range(10) for i in (1, 2)]
    pred = [(f, 11 if f < 5 else 13, 10.2, 5.0) for f in range(10)] + [(f, 12, 20.0, 5.1) for f in range(8)] + [(3, 99, 80.0, 5.0)]
    df = lambda rows: spark.createDataFrame(rows, "frame int, obj_id int, x_m double, y_m double")
    r = evaluation.clear_mot(df(gt), df(pred)).first()
    assert (r["tp"], r["fn"], r["fp"], r["switches"]) == (18, 2, 1, 1) and r["mota"] == pytest.approx((18 - 1 - 1) / 20)
    # a pair that goes on is kept although another one overlaps more
    r = evaluation.clear_mot(df([(f, 1, 0.0, 0.0) for f in range(4)]), df([(f, 5, 0.4, 0.0) for f in range(4)] + [(f, 6, 0.1, 0.0) for f in (2, 3)])).first()
    assert (r["tp"], r["switches"], r["fp"]) == (4, 0, 2)


def test_purity_stitch_needs_more_than_one_pass(spark):
    runs = {1: range(0, 20), 2: range(30, 50), 3: range(60, 80), 4: range(30, 50)}
    obs = [(i, f, f / 25, f * 0.05 + (40.0 if i == 4 else 0.0), 10.0) for i, frames in runs.items() for f in frames]
    df = spark.createDataFrame(obs, "tracklet_id int, frame int, t double, x_m double, y_m double")
    names = lambda n: {r["tracklet_id"]: r["identity_id"] for r in tracking.purity_stitch(df, n).collect()}
    once = names(1)
    assert len({once[1], once[2], once[3]}) == 2 and once[4] == 4
    assert names(3) == {1: 1, 2: 1, 3: 1, 4: 4}
    red, blue = [1.0, 0.0], [0.0, 9.0]
    coloured = df.withColumn("feat", F.when(F.col("tracklet_id") == 2, F.array(*map(F.lit, blue))).otherwise(F.array(*map(F.lit, red))))
    assert {r["tracklet_id"]: r["identity_id"] for r in tracking.purity_stitch(coloured, colour="feat").collect()}[2] == 2


def brute_cuts(rows, jump=3.0):
    """The rule of ``fused_cuts`` for one tracklet, row by row."""
    t = np.array([r[0] for r in rows])
    xy, box = np.array([r[1:3] for r in rows]), np.array([r[3:7] for r in rows])
    tall, wide = box[:, 3] - box[:, 1], box[:, 2] - box[:, 0]
    mid = (box[:, 0] + box[:, 2]) / 2

    def fused(j):
        near = (np.abs(t - t[j]) <= 2 + 1e-9) & (np.arange(len(t)) != j)
        return near.any() and (tall[j] >= 1.25 * np.median(tall[near]) or wide[j] >= 1.5 * np.median(wide[near]))

    out = []
    for i in range(1, len(rows)):
        a = (t >= t[i - 1] - 1 - 1e-9) & (np.arange(len(t)) < i)
        b = (t <= t[i] + 1 + 1e-9) & (np.arange(len(t)) >= i)
        if t[i] - t[i - 1] > 0.35 or a.sum() < 3 or b.sum() < 3:
            continue
        x, y = np.median(xy[a], 0)
        if not (0 <= x <= 100 and -1 <= y <= 65) or np.linalg.norm(xy[i] - xy[i - 1]) <= jump or np.linalg.norm(np.median(xy[b], 0) - np.median(xy[a], 0)) <= jump:
            continue
        if not (fused(i - 1) or fused(i)):
            continue
        move = lambda edge: np.hypot(np.median(mid[b]) - np.median(mid[a]), np.median(edge[b]) - np.median(edge[a]))  # noqa: B023, E731
        if move(box[:, 1]) >= 0.5 * move(box[:, 3]):
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_fused_cuts_against_plain_python(spark, seed):
    rng = np.random.default_rng(seed)
    rows, at = [], np.array([40.0, 30.0])
    for k in range(120):
        if rng.random() < 0.08:
            at = at + rng.choice([-6.0, 6.0], 2)
        x1, y1 = 10 * at
        tall = rng.choice([1.0, 1.6], p=[0.85, 0.15])
        rows.append((3 * k / 25, *(at + rng.normal(0, 0.2, 2)), x1, y1 - 40 * tall + rng.normal(), x1 + 15, y1))
    df = spark.createDataFrame([(7, 3 * k, *map(float, r)) for k, r in enumerate(rows)], "tracklet_id int, frame int, t double, x_m double, y_m double, x1 double, y1 double, x2 double, y2 double")
    got = sorted(r["frame"] // 3 for r in tracking.fused_cuts(df).collect())
    assert got == brute_cuts(rows)


def test_homography_fit(spark):
    h = np.array([[0.05, 0.002, -3.0], [0.001, 0.09, -12.0], [0.00001, 0.0004, 1.0]])
    rng = np.random.default_rng(3)
    rows = []
    for cam in (1, 2):
        px = rng.uniform([100, 100], [1800, 1000], (14, 2))
        m = np.c_[px, np.ones(14)] @ h.T
        m = m[:, :2] / m[:, 2:] + (rng.normal(0, 0.05, (14, 2)) if cam == 2 else 0)
        m[:3] += 20.0  # clicked on the wrong point
        rows += [(cam, f"p{i:02}", *map(float, (*px[i], *m[i]))) for i in range(14)]
    rows += [(3, f"p{i}", float(i), float(i), float(i), float(i)) for i in range(6)] + [(4, "a", 1.0, 2.0, 3.0, 4.0)]
    got = {r["cam"]: r for r in pitch.fit_homography(spark.createDataFrame(rows, "cam int, name string, px double, py double, x_m double, y_m double"), key=["cam"]).collect()}
    assert set(got) == {1, 2} and all(got[c]["inliers"] == 11 and got[c]["clicks"] == 14 for c in got)
    assert np.allclose(np.array(got[1]["h"]).reshape(3, 3), h, atol=1e-6) and got[2]["error_m"] < 0.1
