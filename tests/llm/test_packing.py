import itertools
import random

import pytest

from pitchlake.llm import packing


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    h = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
    k = rng.randint(1, 4)
    pad = lambda ends: sum(n * (min(e for e in ends if e >= x) - x) for x, n in h.items())
    lengths = sorted(h)
    best = min(pad([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
    ends = packing.boundaries(h, k)
    assert len(ends) <= k and ends[-1] == lengths[-1] and pad(ends) == best


def test_no_lengths():
    assert packing.boundaries({}, 3) == []


def test_every_token_is_packed_once(make, prose, odd):
    texts = prose(60, words=90) + odd
    docs = make(list(enumerate(texts)))
    rows = packing.pack(docs, max_tokens=20, buckets=3, budget=64, group_rows=10).collect()
    for i, t in enumerate(texts):
        n = len((t or "").encode().split())
        mine = sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        assert sum(x[2] for x in mine) == n and [x[1] for x in mine] == [20 * k for k in range(len(mine))]
    full = [r for r in rows if r["n_tokens"]]
    assert len({r["bucket_tokens"] for r in full}) <= 3
    batches = {}
    for r in full:
        assert r["n_tokens"] <= r["bucket_tokens"]
        batches.setdefault(r["batch_id"], []).append(r)
    for b in batches.values():
        assert len({r["bucket_tokens"] for r in b}) == 1 and len(b) * b[0]["bucket_tokens"] <= 64
        assert sorted(r["slot"] for r in b) == list(range(len(b)))
    assert all(r["batch_id"] is None for r in rows if not r["n_tokens"])
    assert packing.pack(docs.limit(0)).count() == 0


def test_budget_must_hold_a_sequence(make):
    with pytest.raises(ValueError):
        packing.pack(make([]), max_tokens=100, budget=50)


def test_a_third_of_the_rows_is_one_id_and_text(make, prose):
    """No group is over twice its bound, and repeated rows are sequences each."""
    texts = [*prose(400, 8, words=30), *["the very same text"] * 300]
    docs = make([(i if i < 400 else 7, t) for i, t in enumerate(texts)])
    rows = packing.pack(docs, max_tokens=20, buckets=2, budget=64, group_rows=50).collect()
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r["batch_id"].split("-")[:2]), []).append(r)
    assert max(map(len, groups.values())) <= 100
    assert sum(r["doc_id"] == 7 and r["n_tokens"] == 4 for r in rows) >= 300
    for _, batch in itertools.groupby(sorted(rows, key=lambda r: r["batch_id"]), key=lambda r: r["batch_id"]):
        batch = list(batch)
        assert len(batch) * batch[0]["bucket_tokens"] <= 64 and sorted(r["slot"] for r in batch) == list(range(len(batch)))
