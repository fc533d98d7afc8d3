import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import fingerprint
from pitchlake.llm.common import texts


def likeness(a, b):
    a, b = set(a.split("\n")), set(b.split("\n"))
    return len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), likeness(t, e), likeness(t, nxt))
    return out


@pytest.mark.parametrize("size", [1 << 20, 900])
def test_against_brute_force(make, odd, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", size)
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (size,))
    rng = random.Random(3)
    lines = [f"line {i} é😀" for i in range(300)]
    docs = ["\n".join(rng.choices(lines, k=rng.randint(1, 60))) for _ in range(40)] + odd + ["\n".join(lines * 2), "\n" * 50]
    rng.shuffle(docs)
    rows = [(3 * i - 20, t) for i, t in enumerate(docs)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(texts(make(rows))).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (n, sha, edited, nxt) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(edited) and r["near_next"] == pytest.approx(nxt)
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_large_differences_are_counted(spark):
    df = spark.range(1).select(F.array(*(F.lit(i) for i in range(400))).alias("a"), F.array(*(F.lit(i) for i in range(390, 700))).alias("b"))
    e = df.select(fingerprint._entries(F.col("a").cast("array<bigint>")).alias("a"), fingerprint._entries(F.col("b").cast("array<bigint>")).alias("b"))
    peeled = e.select(fingerprint.peel(fingerprint.subtract(fingerprint.sketch(F.col("a"), 32), fingerprint.sketch(F.col("b"), 32)), 32, 14)).first()[0]
    assert peeled == 390 + 300
    small = e.select(fingerprint.peel(fingerprint.subtract(fingerprint.sketch(F.col("a"), 4), fingerprint.sketch(F.col("b"), 4)), 4, 7)).first()[0]
    assert small is None


def test_one_id_on_a_third_of_the_rows(make, monkeypatch):
    """Texts of one id spread over ranges, and follow each other by their hashes."""
    rng = random.Random(5)
    rows = [(7 if i % 3 == 0 else i, f"text {i}\n{'x' * rng.randrange(90)}") for i in range(240)]
    df = texts(make(rows))
    size = sum(len(t) for _, t in rows) // 20
    ranged = fingerprint.with_next(df, size)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-r[0], hashes[r[1]]))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert {r["text"]: r["next_text"] for r in ranged.collect()} == want
    source = df.select(F.struct(F.col("doc_id").cast("bigint").alias("place"), F.bitwise_not(F.xxhash64("text")).alias("back")).alias("place"))
    cuts = fingerprint.bounds_of(source, 20)
    assert len(cuts) == 19 and 4 <= sum(c["place"] == 7 for c in cuts) <= 9


def test_one_document_null_ids_and_none(make):
    r = fingerprint.fingerprints(texts(make([(5, "ab\ncd")]))).first()
    assert r["near_next"] == 1.0
    rows = fingerprint.fingerprints(texts(make([(5, "a"), (5, "a"), (None, "b"), (None, None)]))).collect()
    assert len(rows) == 4
    assert fingerprint.fingerprints(texts(make([]))).count() == 0
