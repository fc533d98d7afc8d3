"""Alignment of two tokenizers against a plain pass over all tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from pitchlake.llm import align

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    return align.Tokenizers.load(*PATHS)


def brute(texts, t):
    """The contract's columns for each text, from whole encodings and a walk along both."""
    links, out = [], []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = (t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)) if text else ([], [])
        if b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
            links.append([])
            out.append([0, 0, 0, 0])
            continue
        own, groups, i, j, a_end, b_end, group = [], [], 0, 0, len(t.a_bytes[a[0]]), len(t.b_bytes[b[0]]), ([], [])
        while True:
            own.append((a[i], b[j]))
            a_done, b_done = a_end <= b_end, b_end <= a_end
            if a_done:
                group[0].append(a[i])
            if b_done:
                group[1].append(b[j])
            if a_done and b_done:
                groups.append("|".join(",".join(map(str, x)) for x in group))
                group = ([], [])
                if i + 1 == len(a):
                    break
            i, j = i + a_done, j + b_done
            a_end += len(t.a_bytes[a[i]]) * a_done
            b_end += len(t.b_bytes[b[j]]) * b_done
        links.append(own)
        out.append([len(a), len(b), len(groups), len(own), ";".join(groups)])
    counts = Counter(x for own in links for x in own)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for x, own in zip(out, links, strict=True):
        sha = hashlib.sha256(x[4].encode()).hexdigest() if len(x) > 4 else ""
        rows.append((*x[:4], sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), sha))
    return rows, counts, top


def held(df, texts, t, ids=None):
    want, _, _ = brute(texts, t)
    rows = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect())
    assert rows == Counter((i, *w) for i, w in zip(ids or range(len(texts)), want, strict=True))


ODD = [
    " leading", "trailing  ", "two  spaces inside", "tab\tand\nlines \n x", "a ▁mark", "<s> </s> <|endoftext|> <0x41> x", "ﬁ ① naïve　wide", "ta'll 's don't I'd", "100 000.5 %%% a-b", "ÿ ɏ ɐ x",
    "😀 😀😀 ‍ x", "한국어 텍스트 と日本語", "x" * 700 + " y", "\x00 \x01 b", " ", "\n", "a", "- -- ---", "  nbsp x", "ſ K",
]


def test_contract(spark, make, prose, odd, tokenizers):
    texts = [*prose(40, 3, 120, 300), *odd, *ODD, *["the same text, again"] * 30]
    a = align.align(make(list(enumerate(texts))), *PATHS, run_bytes=4000, stripes=7)
    held(a.documents(), texts, tokenizers)
    _, counts, top = brute(texts, tokenizers)
    pairs = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in a.pairs().collect()}
    assert pairs == {p: (n, n == top[p[1]]) for p, n in counts.items()}


def test_parts(spark, make, prose, tokenizers, monkeypatch):
    """Salted stripes, flushed sums and slices of a long text change nothing; a third of the rows is one id and text."""
    monkeypatch.setattr(align, "MET_BYTES", 64)
    monkeypatch.setattr(align, "HELD_PAIRS", 200)
    monkeypatch.setattr(align, "SLICE", 50)
    monkeypatch.setattr(align, "TOGETHER", 3)
    texts = [*prose(20, 5, 60, 200), " ".join(prose(30, 6, 90, 200)), *["hot text " * 9] * 20]
    ids = [*range(21), *[7] * 20]
    docs = make(list(zip(ids, texts, strict=True))).repartition(5)
    held(align.align(docs, *PATHS, run_bytes=900, stripes=3).documents(), texts, tokenizers, ids)


def test_empty_and_kept(spark, make, tokenizers):
    assert align.align(make([]), *PATHS).documents().count() == 0
    assert {tuple(r) for r in align.align(make([(1, None), (None, "")]), *PATHS).documents().select("doc_id", *COLUMNS[:6]).collect()} == {(1, *[0] * 6), (None, *[0] * 6)}
    row = align.align(make([(None, "hello world")]), *PATHS, keep=True).documents().first()
    assert row["doc_id"] is None and hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]
    ids = [[int(i) for i in side.split(",")] for g in row["groups"].split(";") for side in g.split("|")]
    assert b"".join(tokenizers.a_bytes[i] for g in ids[::2] for i in g) == b" hello world" == b"".join(tokenizers.b_bytes[i] for g in ids[1::2] for i in g)


def test_columns_of_other_names(spark, tokenizers):
    docs = spark.createDataFrame([("k", "some words", 3, 4)], "name string, body string, n_a int, run int")
    row = align.align(docs, *PATHS, "name", "body").documents().first()
    assert row["doc_id"] == "k" and row["n_links"] >= 2 and np.isfinite(row["count_sum"])
