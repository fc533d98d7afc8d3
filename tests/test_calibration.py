"""Shaken clicks, clicks on the border, principal components, annotation files."""

import numpy as np
from pyspark.sql import functions as F

from pitchlake import sources
from pitchlake.operators import metrics, pitch, reduction

H = np.array([[0.05, 0.002, -3.0], [0.001, 0.09, -12.0], [0.00001, 0.0004, 1.0]])


def clicks(spark, cameras=("a", "b")):
    back = np.linalg.inv(H)
    rows = []
    for c in cameras:
        for i, (x, y) in enumerate([(0, 0), (40, 0), (90, 5), (0, 60), (45, 55), (95, 60), (30, 30), (70, 35)]):
            p = back @ [x, y, 1]
            rows.append((c, f"p{i}", float(p[0] / p[2]), float(p[1] / p[2]), float(x), float(y)))
    return spark.createDataFrame(rows, "camera string, name string, px double, py double, x_m double, y_m double")


def test_stability_equals_a_plain_simulation(spark):
    places = [(5.0, 5.0), (50.0, 30.0), (95.0, 62.0)]
    got = {(r["camera"], r["x_m"]): r for r in pitch.click_stability(clicks(spark), places, 1.0, 120, fours=20, key=["camera"]).collect()}
    assert set(got) == {(c, x) for c in "ab" for x, _ in places} and all(r["fits"] > 100 for r in got.values())
    rng, data = np.random.default_rng(3), clicks(spark, ("a",)).toPandas()
    px, m, back = data[["px", "py"]].to_numpy(), data[["x_m", "y_m"]].to_numpy(), np.linalg.inv(H)
    target = np.c_[places, np.ones(3)] @ back.T
    target = np.c_[target[:, :2] / target[:, 2:], np.ones(3)]
    moved = []
    for _ in range(600):
        at = target @ pitch.least_squares_homography(px + rng.normal(0, 1.0, px.shape), m).T
        moved.append(at[:, :2] / at[:, 2:])
    away = np.linalg.norm(np.array(moved) - np.mean(moved, 0), axis=2)
    for (x, _), usual in zip(places, np.median(away, 0), strict=True):
        for c in "ab":
            assert abs(got[c, x]["moved_m"] / usual - 1) < 0.35
    # another key: other noise
    assert got["a", 5.0]["moved_m"] != got["b", 5.0]["moved_m"]


def test_stability_does_not_depend_on_partitions(spark):
    one = pitch.click_stability(clicks(spark, ("a",)).coalesce(1), [(50.0, 30.0)], trials=8, fours=10).first()
    many = pitch.click_stability(clicks(spark, ("a",)).repartition(5), [(50.0, 30.0)], trials=8, fours=10).first()
    assert abs(one["moved_m"] - many["moved_m"]) < 1e-9
    # exact clicks do not move
    assert pitch.click_stability(clicks(spark, ("a",)), [(50.0, 30.0)], 0.0, 5, fours=10).first()["moved_m"] < 1e-6


def test_too_few_clicks_give_no_row(spark):
    assert pitch.click_stability(clicks(spark).where("name < 'p3'"), [(50.0, 30.0)], trials=3).collect() == []


def test_edge_clicks(spark):
    df = spark.createDataFrame([("in", 3.0, 3.0), ("left", 2.0, 50.0), ("top", 50.0, 0.0), ("right", 97.0, 50.0), ("low", 50.0, 47.5), ("null", None, 5.0)], "name string, px double, py double")
    assert {r["name"] for r in pitch.edge_clicks(df, 100, 50).collect()} == {"left", "top", "right", "low"}


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 12)) * 4 + rng.normal(size=(400, 12)) * 0.1 + 1000.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, []), (-3, [float("nan")] * 12), (-4, [1.0] * 5), (-5, [None] * 12)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(7)
    c = reduction.principal(df, "v", 4)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(c.mean, x.mean(0)) and np.allclose(c.variance, s[:4] ** 2 / 399)
    assert np.allclose(np.abs((c.base * vt[:4]).sum(1)), 1, atol=1e-6)
    low = df.withColumn("low", reduction.projected(F.col("v"), c)).withColumn("e", reduction.squared_error(F.col("v"), F.col("low"), c)).collect()
    got = {r["id"]: r for r in low}
    assert all(got[i]["low"] is None for i in range(-5, 0))
    assert np.allclose([got[i]["low"] for i in range(400)], (x - x.mean(0)) @ c.base.T, atol=1e-6)
    assert np.isclose(sum(got[i]["e"] for i in range(400)), (s[4:] ** 2).sum())
    # all of them restore the vector; a table without vectors has none
    every = reduction.principal(df, "v", 99)
    assert every.base.shape == (12, 12)
    assert df.where("id >= 0").select(F.max(reduction.squared_error(F.col("v"), reduction.projected(F.col("v"), every), every))).first()[0] < 1e-9
    assert reduction.principal(df.where("id < -4"), "v", 3) is None


def test_annotation_file_round_trip(spark, tmp_path):
    rows = [(30, 7, 100.456, 200.0, "A"), (12, 7, 90.0, 190.0, None), (12, 9, 50.0, 60.0, "referee"), (30, 11, 10.0, 20.0, None)]
    df = spark.createDataFrame(rows, "frame int, obj_id int, px double, py double, team string")
    path = str(tmp_path / "annotation")
    sources.write_cvat(sources.cvat_tracks(df), path)
    got = sorted((r["obj_id"], r["frame"], r["label"], r["team"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in sources.read_cvat(spark, path).collect())
    assert got == [
        (0, 0, "player", "A", 81.0, 150.0, 99.0, 190.0), (0, 1, "player", "A", 91.46, 160.0, 109.46, 200.0),
        (1, 0, "referee", None, 41.0, 20.0, 59.0, 60.0), (2, 1, "player", None, 1.0, -20.0, 19.0, 20.0),
    ]


def test_series_summary(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.24), (0, None), (1, 5.0)], "team int, y double")
    assert sorted(map(tuple, metrics.series_summary(df, "team", "y").collect())) == [(0, 1.6, 1.0, 2.2), (1, 5.0, 5.0, 5.0)]
