"""Quality trees: statistics against plain Python, splits against enumeration, scores against a walk down each tree, held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from pitchlake.llm import quality

DATA = "/root/testdata/sf0.01"


def plain(text):
    """Shares of classes and of neighbours, byte by byte."""
    raw = (text or "").encode()
    kinds = [next((i for i, g in enumerate(quality._GROUPS) if b < 128 and chr(b) in g), quality.CONTROL if b < 128 else quality.FIRST if b >= 192 else quality.FURTHER) for b in raw]
    coarse = [quality._COARSE[k] for k in kinds]
    single = [kinds.count(i) / max(1, len(text or "")) for i in range(quality.CLASSES - 1)]
    pairs = [0.0] * quality.COARSE**2
    for a, b in zip(coarse, coarse[1:]):
        pairs[a * quality.COARSE + b] += 1 / (len(raw) - 1)
    return single + pairs


def test_statistics(prose, odd, monkeypatch):
    monkeypatch.setattr(quality, "SLICE", 37)  # slices cut texts, and batches of texts, anywhere
    texts = [*prose(20, 1, 40), *odd]
    x = quality.statistics(texts)
    assert x.shape == (len(texts), quality.FEATURES) and np.isfinite(x).all()
    want = np.array([plain(t) for t in texts])
    assert np.allclose(x[:, : want.shape[1]], want, atol=1e-6)
    assert not quality.statistics(["", None]).any()
    echo = quality.statistics(["De De De De", "a b\na b"])[:, -len(quality.WORDS) :]
    assert echo[0].tolist() == pytest.approx([np.log1p(4), np.log1p(2), 0.25, 0.75, 1.0, 0.25, 1.0, np.log1p(4)])


def test_splits_and_flat_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).astype("f4")
    label = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype("i8")
    edges = quality.cuts(x, 8)
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)
    g, h = 0.5 - label, np.full(300, 0.25)
    nodes, leaf = quality.grow(binned, g, h, 8, 1)
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.L2)
    gains = {(f, b): part(binned[:, f] <= b) + part(binned[:, f] > b) for f in range(4) for b in range(7) if min((binned[:, f] <= b).sum(), (binned[:, f] > b).sum()) * 0.25 >= quality.LEAST_WEIGHT / 4}
    assert tuple(nodes[0][:2]) == max(gains, key=lambda k: (round(gains[k], 9), -k[0], -k[1]))
    left = binned[:, nodes[0][0]] <= nodes[0][1]
    assert nodes[nodes[0][2]][4] == pytest.approx(-quality.RATE * g[left].sum() / (h[left].sum() + quality.L2)) and set(leaf[left]) == {nodes[0][2]}
    forest = quality.fit(x, label, np.ones(300), trees=15)
    assert len(forest.roots) > 5 and ((forest.score(x) > 0.5) == label).mean() > 0.95

    def walk(row, node):
        for _ in range(forest.depth):
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        return forest.value[node]

    assert forest.raw(x[:40]).tolist() == pytest.approx([forest.base + sum(walk(r, n) for n in forest.roots) for r in x[:40]])


def junk(i):
    return " ".join(f"w{(i * k) % 17}***" for k in range(1, 30))


@pytest.fixture(scope="module")
def corpus(prose):
    return [(i, junk(i) if i % 4 == 0 else t) for i, t in enumerate(prose(240, 21, 60))]


def test_labels(spark, make, corpus, odd):
    """Nulls, other labels, both labels, repeats and a hot id; the held-out fold teaches nothing."""
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(odd)), (None, "no id"), *[(3, corpus[3][1])] * 120]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    labels = [(i, int(i % 4 > 0) if not held(i) else int(i % 4 == 0)) for i in range(240)] + [(5, 1)] * 90 + [(6, None), (None, 1), (7, 9)]
    df = quality.classify(make(rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["predicted"] == (r["doc_id"] % 4 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 240)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1


def test_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert {(r["score"], r["predicted"]) for r in quality.classify(make([(1, "a b"), (2, None)]), none).collect()} == {(0.5, 0)}
    assert quality.classify(make([]), none).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.classify(make([(1, "a b")]), one).first()["score"] > 0.5


def test_sample_is_bounded(spark, make, corpus):
    table = quality.described(make([*corpus, *[(1, "hot")] * 200]).select("doc_id", "text"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(240)], "doc_id long, quality int")
    x, y, w = quality.sample(table, labels, 40)
    assert len(x) <= 40 and sorted(set(y.tolist())) == [0, 1] and (w[y == 1].sum() / w[y == 0].sum()) == pytest.approx(3, rel=0.4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in quality.op11(spark, DATA).collect() if r["held_out"] and truth.get(r["doc_id"]) in (0, 1)]
    assert len(rows) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= 0.95
