import numpy as np
from pyspark.sql import functions as F

from pitchlake.llm import ann


def brute(rows, is_query, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if is_query(q):
            s = sorted((-float((v * u).sum()), i) for i, u in good if i != q)[:k]
            out[q] = [i for _, i in s]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, part string")


def test_exact_when_small_and_ties(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((80, 16)).astype("f4").astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100 + i, v[0].tolist()) for i in range(30)]
    rows += [(200, None), (220, [0.0] * 16), (240, [float("nan")] * 16), (260, [None] * 16), (280, [1.0] * 3), (None, v[1].tolist()), (300, [-float(x) for x in v[2]])]
    got = {}
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(rows, lambda q: q % 20 == 0, 20)


def test_few_candidates(spark):
    rows = [(20, [1.0] * 16), (21, [2.0] * 16)]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 21, 32.0)]
    assert ann.search(frame(spark, rows[:1]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_with_many_parts(spark, monkeypatch):
    for name, value in (("PART_ROWS", 60), ("GROUP_ROWS", 100), ("SAMPLE_ROWS", 1200)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16)) * 2
    v = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype("f4").astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.astype("f4").astype(float).tolist()) for i, x in enumerate(v)]
    got = {}
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((512, 8))
    label = ann.partition(ann._neighbours(x, 8), 8, rng)
    assert np.bincount(label).tolist() == [64] * 8


def test_repeated_queries_get_all_their_neighbours(spark):
    rng = np.random.default_rng(4)
    v = [x.tolist() for x in rng.standard_normal((70, 16)).astype("f4").astype(float)]
    # 20 twice and 40 thirty times with one vector, which ids 101 to 125 share with 40; 60 with thirty vectors near each other; 7 three times
    rows = list(enumerate(v)) + [(20, v[20])] + [(40, v[40])] * 29 + [(100 + i, v[40]) for i in range(1, 26)] + [(7, v[7])] * 2
    rows += [(60, (np.array(v[60]) * (1 + i / 64)).astype("f4").astype(float).tolist()) for i in range(1, 30)]
    rows = [r for r in rows if r[0] != 60 or r[1] != v[60]] + [(60, v[60])]
    # each row of a query gets its own list, without itself alone
    good = [(i, np.array(x)) for i, x in rows]
    want = sorted((q, n + 1, i) for at, (q, x) in enumerate(good) if q % 20 == 0 for n, (_, i) in enumerate(sorted((-float((x * u).sum()), i) for j, (i, u) in enumerate(good) if j != at)[:20]))
    got = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == want


def test_one_id_with_two_vectors(spark):
    unit = lambda *x: [float(a) for a in x] + [0.0] * (16 - len(x))
    rows = [(20, unit(1, 0)), (20, unit(0, 1)), (1, unit(5, 7)), (2, unit(1, 1))]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted([(20, 1, 1, 5.0), (20, 2, 2, 1.0), (20, 3, 20, 0.0), (20, 1, 1, 7.0), (20, 2, 2, 1.0), (20, 3, 20, 0.0)])


def clustered(rng, n, centres, width=16, spread=0.35):
    c = rng.standard_normal((centres, width)) * 2
    v = c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4")


def written(spark, v, folder):
    import pyarrow as pa
    import pyarrow.parquet as pq

    flat = pa.array(v.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], "i4"), flat)}), f"{folder}/v.parquet")
    return spark.read.parquet(f"{folder}/v.parquet")


def recall(got, v, k=20, every=20):
    q = np.arange(0, len(v), every)
    x = v.astype(float)
    hits = 0
    for a in range(0, len(q), 500):
        s = x[q[a : a + 500]] @ x.T
        s[np.arange(len(s)), q[a : a + 500]] = -np.inf
        true = np.argpartition(-s, k, axis=1)[:, :k]
        hits += sum(len(got[int(i)] & set(t.tolist())) for i, t in zip(q[a : a + 500], true, strict=True))
    return hits / (len(q) * k)


def searched(spark, rows, monkeypatch):
    """Neighbours by query, and the mean share of all leaves that a query is sent to."""
    seen = []
    plain = ann.leaves
    monkeypatch.setattr(ann, "leaves", lambda routed, models, every: seen.append(plain(routed, models, every)) or seen[-1])
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    sent, all_ = seen[1].agg(F.avg(F.size("leaves"))).first()[0], seen[0].select(F.explode("leaves")).distinct().count()
    return got, sent / all_, all_


def test_two_levels_of_parts(spark, monkeypatch, tmp_path):
    for name, value in (("PART_ROWS", 150), ("SAMPLE_ROWS", 1000)):
        monkeypatch.setattr(ann, name, value)
    v = clustered(np.random.default_rng(5), 20000, 200)
    got, share, all_ = searched(spark, written(spark, v, tmp_path), monkeypatch)
    # 1,000 sampled vectors make at most 31 parts; the second level makes more of them
    print(f"{all_} leaves, {share:.3f} of them searched")
    assert all_ > 31 and share <= 0.25
    assert recall(got, v) >= 0.9


def test_recall_on_a_hundred_thousand(spark, monkeypatch, tmp_path):
    v = clustered(np.random.default_rng(6), 100_000, 500)
    got, share, all_ = searched(spark, written(spark, v, tmp_path), monkeypatch)
    found = recall(got, v)
    print(f"{all_} leaves, {share:.3f} of them searched, recall {found:.3f}")
    assert share <= 0.25 and found >= 0.9
