"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import pytest

from pitchlake.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """docs, items: (id, text). Rows of the result."""
    tf = [Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    n_docs, n_terms, df = sum(x > 0 for x in n), sum(n), Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _), c, length in zip(docs, tf, n, strict=True):
            score = 0
            for t, times in Counter(words(text)).items():
                if c[t]:
                    m = 100 - 75 + (75 * length * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if null else doc_id, -s) for rank, (s, null, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def found(docs, items, **more):
    df = search.rank(docs, items, **more)
    assert dict(df.dtypes)["rank"] == "int" and dict(df.dtypes)["score"] == "bigint"
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture
def ask(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string, score double, rank string")


def test_scores(make, ask, prose, odd):
    docs = [*enumerate(prose(150, 11, 60, 90)), *((200 + i, t) for i, t in enumerate(odd)), *((300 + i, "equal text of ties") for i in range(25)), (None, "equal text of ties")]
    texts = [*prose(8, 12, 25, 90), "ties of EQUAL, equal-text", "straße ſ k 😀😀", "nowhere!", "", None, docs[3][1]]
    items = [*enumerate(texts), (8, texts[8]), (None, texts[0])]
    got = found(make(docs).repartition(3), ask([(i, t, 0.5, "x") for i, t in items]))
    assert got == brute(docs, items)


def test_blocks_shards_and_slices(make, ask, prose, monkeypatch):
    """Many blocks of items, shards and slices, ranges of two: the same rows. A third of the rows is one id and text."""
    for name, value in (("SHARD_BYTES", 2000), ("BLOCK_BYTES", 300), ("FANOUT", 2), ("SLICE", 64)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(search.index, "__defaults__", (2000,))
    monkeypatch.setattr(search.item_blocks, "__defaults__", (300,))
    docs = [*enumerate(prose(60, 13, 40, 60)), (70, " ".join(prose(40, 14, 60, 60))), *[(9, "one hot text here")] * 30]
    items = [*enumerate(prose(4, 15, 30, 60)), (5, "hot text")]
    assert found(make(docs).repartition(4), ask([(i, t, 0.5, "x") for i, t in items])) == brute(docs, items)


def test_tables_without_rows(make, ask):
    assert not found(make([]), ask([(1, "a b", 0.5, "x")])) and not found(make([(1, "a b")]), ask([])) and not found(make([(1, None), (2, "!!")]), ask([(1, "a", 0.5, "x")]))


def test_bounds_save_work(prose, monkeypatch):
    """A tree bounds what is below it, and a search of rare terms opens few ranges."""
    monkeypatch.setattr(search, "FANOUT", 8)
    texts = prose(3000, 16, 40, 4000)
    number = {w: i for i, w in enumerate(sorted({w.encode() for t in texts for w in words(t)}))}
    p = search.Postings.of(list(range(3000)), texts, number)
    n_docs, n_terms = sum(p.lengths > 0), p.lengths.sum()
    tree = search.MaxTree(p, int(n_docs), int(n_terms))
    df = Counter(p.term.tolist())
    asked = [(number[w.encode()], search.weight(int(n_docs), df[number[w.encode()]])) for w in dict.fromkeys(words(texts[17]))]
    factors = tree.factors(asked)
    for level in range(1, len(tree.levels)):
        for above in range(-(-tree.sizes[level] // search.FANOUT)):
            for i, bound in enumerate(tree.opened(factors, level, above).tolist()):
                assert bound >= max(tree.opened(factors, level - 1, above * search.FANOUT + i).tolist())
    top, opened = search.best(tree, p.ids, asked, 3)
    assert max(top)[1] == 17 and opened < 3000 / search.FANOUT / 2
