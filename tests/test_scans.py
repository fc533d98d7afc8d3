"""Global orders without one task: sums and places against plain Python, plans without a window over everything."""

import itertools
import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchlake import sources
from pitchlake.operators import matching, metrics, scans


def single(df):
    """Does the plan bring all rows into one task for a window?"""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return re.search(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan) is not None


def test_what_single_means(spark):
    rows = spark.range(9).withColumn("n", F.row_number().over(W.orderBy("id")))
    assert single(rows) and not single(spark.range(9).agg(F.sum("id")))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_sums_and_places(spark, parts):
    rng = random.Random(parts)
    rows = [(k, rng.randint(-5, 9), rng.random()) for k in rng.sample(range(1000), 200)]
    df = scans.running(spark.createDataFrame(rows, "k int, a int, b double").repartition(5), "k", {"s": F.col("a"), "t": F.col("b"), "n": F.lit(1)}, parts)
    assert not single(df)
    got = {r["k"]: (r["s"], r["t"], r["n"]) for r in df.collect()}
    rows.sort()
    sums = zip(itertools.accumulate(a for _, a, _ in rows), itertools.accumulate(b for _, _, b in rows), itertools.count(1))
    assert got == {k: (s, pytest.approx(t), n) for (k, _, _), (s, t, n) in zip(rows, sums)}
    assert scans.numbered(spark.createDataFrame([], "k int"), "k", parts=parts).count() == 0


def test_queries_have_no_window_over_everything(spark):
    obs = spark.createDataFrame([(f, i, 1.0, 2.0) for f in range(0, 90, 3) for i in range(3)], "frame int, obj_id int, x_m double, y_m double")
    assert not single(sources.mot_rows(obs)) and {r["frame"] for r in sources.mot_rows(obs).collect()} == set(range(1, 31))
    rows = spark.createDataFrame([(float(v % 7), float(v)) for v in range(50)], "v double, w double")
    assert not single(metrics.weighted_quantile(rows, "v", "w", 0.5))
    people = spark.createDataFrame([(f, i, i % 2, "A") for f in range(0, 60, 3) for i in range(14 if 15 <= f < 45 else 3)], "frame int, id_jugador int, equipo int, etiqueta string")
    assert not single(metrics.densest_window(people, 5)) and metrics.densest_window(people, 5).collect() == [(15, 5)]


def test_identities_of_matches_apart(spark):
    """The best one-to-one map of each match, against all permutations, in one table of two matches."""
    rng = random.Random(3)
    counts = {(m, g, p): rng.randint(0, 6) for m in (0, 1) for g in range(4) for p in range(5)}
    pairs = spark.createDataFrame([(m, 10 * m + g, 100 * m + p) for (m, g, p), n in counts.items() for _ in range(n)], "match_no int, gt_id int, pred_id int")
    got = matching.identity_map(pairs, ["match_no"]).collect()
    for m in (0, 1):
        best = max(sum(counts[m, g, p] for g, p in zip(range(4), chosen)) for chosen in itertools.permutations(range(5), 4))
        own = [r for r in got if r["match_no"] == m]
        assert sum(r["n"] for r in own) == best and len({r["gt_id"] for r in own}) == len(own) == len({r["pred_id"] for r in own})
    assert matching.identity_map(pairs.where("gt_id < 0")).count() == 0
