import itertools
import random

import pytest

from pitchlake.llm import ngram_join


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * n >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 0), (5, 80, 1), (4, 85, 2)])
def test_against_brute_force(make, prose, odd, monkeypatch, k, percent, seed):
    for name, value in (("BLOCK_BYTES", 4000), ("BUCKET_BYTES", 8000), ("GROUP_ROWS", 4), ("QUERY_ROWS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(seed)
    base = prose(25, seed, words=120)
    texts = base + [edited(rng, t, rng.randint(0, 4)) for t in base for _ in range(3)] + odd + base[:5] + [base[0].upper(), base[1] + "\n"]
    shared = base[0]
    texts += [f"{shared} {edited(rng, shared, 3)}" for _ in range(12)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(make(rows).select("doc_id", "text").na.fill("", ["text"]), k, percent).collect())
    assert got == brute(rows, k, percent)


def test_edges(spark, make):
    docs = make([(1, ""), (2, ""), (None, "a b"), (5, "a b"), (5, "a b"), (7, "A  b")]).select("doc_id", "text")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.join(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (None, 5), (5, 5), (5, 5), (7, 5)], key=str)
    assert ngram_join.join(docs.limit(0)).count() == 0
