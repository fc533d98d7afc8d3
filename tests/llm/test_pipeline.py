"""Each stage of the pipeline against plain Python on a small corpus."""

import random

import pytest

import corpus_pipeline as cp

from .test_ngram_join import brute as components
from .test_substring import brute as cut


def english(rng, n):
    parts = "the ing on er th an at re to ed".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [english(rng, rng.randint(20, 200)) for _ in range(40)]
    texts = base + base[:6] + [base[7] + " more", None, "", "123 456"] + [f"{english(rng, 30)} token=abcdef123456 {english(rng, 5)}"]
    passage = english(rng, 60)
    texts += [f"{english(rng, 80)} {passage} {english(rng, 80)}" for _ in range(3)]
    return list(enumerate(texts))


def test_stages(spark, make, corpus):
    docs = make(corpus, ["en"] * len(corpus))
    columns = docs.columns
    got = cp.language(spark, docs, "").cache()
    assert got.columns == columns
    left = sorted(r["doc_id"] for r in got.collect())
    assert left == [i for i, t in corpus if t and any(c.isalpha() for c in t)]
    rows = [(i, t) for i, t in corpus if i in set(left)]

    got = cp.near_duplicates(spark, got, "").cache()
    assert got.columns == columns
    stay = {i for i, _, c in components(rows, cp.SHINGLE, cp.PERCENT) if i == c}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(stay)
    rows = [(i, t) for i, t in rows if i in stay]

    got = cp.repeated_passages(spark, got, "").cache()
    assert got.columns == columns
    want = {i: (t if not gone else kept) for (i, t), (_, n, gone, kept) in zip(sorted(rows, key=lambda r: str((r[0], len((r[1] or "").split())))), cut(rows, cp.WINDOW), strict=True) if not gone or gone < n}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())

    got = cp.secret_values(spark, got, "").cache()
    assert got.columns == columns and got.count() == len(want)
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert not any("token=abcdef123456" in t for t in text.values()) and sum("[secret]" in t for t in text.values()) == 1

    packed = cp.batches(spark, got, "").collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len(t.split()) for t in text.values())


def test_repeated_rows_and_null_ids(spark, make):
    docs = make([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "h i j k l m"), (2, None)], ["en"] * 4)
    assert cp.near_duplicates(spark, docs, "").count() == 3
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_without_labels_all_texts_stay(spark, make):
    docs = make([(1, "abc def"), (2, None), (3, "12 34"), (4, "ä"), (None, "x")])
    assert sorted(str(r["doc_id"]) for r in cp.language(spark, docs, "").collect()) == ["1", "4", "None"]
