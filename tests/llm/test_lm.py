import collections
import math

import pytest

from pitchlake.llm import lm


def model(texts, smoothing):
    """Counts of training texts, and p(word | context) as one recursive formula, without states or arcs."""
    counts = collections.Counter()
    for words in texts:
        seq = ["<s>", *words, "</s>"]
        counts.update(tuple(seq[i:j]) for i in range(len(seq)) for j in range(i + 1, min(len(seq), i + 1 + len(smoothing)) + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",))
    v = sum(1 for g in counts if len(g) == 1 and g != ("<s>",))

    def p(word, context):
        if not context:
            return (counts[word,] + 1) / (n + v + 1)
        m = smoothing[len(context) - 1]
        return (counts[(*context, word)] + m * p(word, context[1:])) / (counts[tuple(context)] + m)

    return counts, n, p


@pytest.mark.parametrize(("block", "smoothing", "segment"), [(1 << 20, (50.0, 5.0), 256), (700, (50.0, 5.0), 7), (700, (3.0,), 5), (5000, (9.0, 4.0, 2.0), 4)])
def test_against_brute_force(spark, prose, odd, monkeypatch, block, smoothing, segment):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2 * block)
    monkeypatch.setattr(lm, "SEGMENT", segment)
    texts = prose(25, words=60, vocabulary=12) + prose(4, seed=5, words=3000, vocabulary=200) + odd + prose(5, words=60, vocabulary=12)
    rows = [(i, t, i % 4 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t or "", h) for i, t, h in rows], "doc_id long, text string, held_out boolean")
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] for i, t, _ in rows}
    counts, n, p = model([words[i] for i, _, held in rows if not held], smoothing)
    got = {r["doc_id"]: r for r in lm.score(docs, len(smoothing) + 1, smoothing).collect()}
    assert len(got) == len(rows)
    for i, _, held in rows:
        seq, k, r = ["<s>", *words[i], "</s>"], len(smoothing), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(seq) - 1, sum(counts[w,] > 0 for w in seq[1:]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(p(w, ())) for w in seq[1:]))
        assert r["score"] == pytest.approx(sum(math.log10(p(seq[j], tuple(seq[max(0, j - k) : j]))) for j in range(1, len(seq))))


def test_probabilities_after_any_context_sum_to_one():
    counts, _, p = model([list("abab"), list("abc"), list("ba")], lm.SMOOTHING)
    words = [g[0] for g in counts if len(g) == 1 and g != ("<s>",)]
    for context in ((), ("a",), ("a", "b"), ("<s>", "b"), ("c", "a")):
        assert sum(p(w, context) for w in [*words, "unknown"]) == pytest.approx(1)


def test_wrong_order(spark):
    with pytest.raises(ValueError):
        lm.score(spark.createDataFrame([], "doc_id long, text string, held_out boolean"), 3, (1.0,))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", True), (None, "", True), (1, "a b", True)], "doc_id long, text string, held_out boolean")
    rows = lm.score(docs).collect()
    assert len(rows) == 3 and all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in rows)
    assert lm.score(docs.limit(0)).count() == 0


def test_a_third_of_the_rows_is_one_id_and_text(spark, prose, monkeypatch):
    """Hot rows are counted each, and each gets the same score, whatever block it is in."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1400)
    texts = prose(40, 2, words=40, vocabulary=15)
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(7, "hot text hot", False)] * 20 + [(-1, "a very long query " * 3000, True)]
    counts, n, p = model([t.split() for _, t, held in rows if not held], (5.0, 2.0))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), 3, (5.0, 2.0)).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    for text, mine in (("hot text hot", [r for r in got if r["doc_id"] == 7 and r["n_tokens"] == 4]), (rows[-1][1], [r for r in got if r["doc_id"] == -1])):
        seq = ["<s>", *text.split(), "</s>"]
        assert mine and all(r["score"] == pytest.approx(sum(math.log10(p(seq[j], tuple(seq[max(0, j - 2) : j]))) for j in range(1, len(seq)))) for r in mine)
