import collections
import random

import numpy as np
import pytest

from pitchlake.llm import blocks, substring


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "seed", "fan"), [(35, 0, 4096), (8, 1, 4096), (5, 2, 4096), (8, 3, 3)])
def test_against_brute_force(make, prose, odd, monkeypatch, window, seed, fan):
    for name, value in (("BLOCK_BYTES", 3000), ("BUCKET_BYTES", 6000), ("MOST", 7)):
        monkeypatch.setattr(substring, name, value)
    monkeypatch.setattr(blocks, "ARITY", 2)
    monkeypatch.setattr(blocks, "FAN", fan)
    rng = random.Random(seed)
    base = prose(40, seed, words=150)
    passage = " ".join(base[0].split()[:60] + base[1].split()[:60])
    texts = base + odd + base[:3] + [f"{rng.choice(base)} {passage} {rng.choice(base)}" for _ in range(15)] + ["la " * 200, "la la " + "lo " * 60, passage * 3]
    rows = list(enumerate(texts))
    docs = make([(i, t or "") for i, t in rows]).select("doc_id", "text")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs, window).collect()), key=str)
    assert got == brute(rows, window)


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_and_places(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 40, 25)
    tokens = rng.integers(1, 4, lengths.sum())
    ends = np.cumsum(lengths)
    index = substring.FmIndex(tokens, lengths)
    parts = [tuple(tokens[e - n : e].tolist()) for e, n in zip(ends, lengths, strict=True)]
    asked = [tuple(rng.integers(0, 4, n).tolist()) for n in rng.integers(1, 30, 20)] + [p for p in parts if p]
    flat = np.array([x for p in asked for x in p])
    stops = np.cumsum([len(p) for p in asked])
    starts = stops - [len(p) for p in asked]
    for window, least in ((1, 1), (4, 1), (4, 2), (9, 1)):
        places = collections.defaultdict(set)
        for d, p in enumerate(parts):
            for k in range(len(p)):
                for stop in range(k + 1, len(p) + 1):
                    places[p[k:stop]].add((d, k))
        covered = collections.defaultdict(set)
        for piece, a, b, low, high in zip(*(x.tolist() for x in index.stretches(flat, starts, stops, window, least)), strict=True):
            run = tuple(flat[a:b].tolist())
            docs, at = index.locate(np.arange(low, high))
            assert set(zip(docs.tolist(), at.tolist(), strict=True)) == places[run] and high - low >= least and b - a >= window
            # no longer stretch ends here
            assert a == starts[piece] or len(places[tuple(flat[a - 1 : b].tolist())]) < least
            covered[piece].update(range(a, b - window + 1))
        for piece, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            assert covered[piece] == {k for k in range(a, b - window + 1) if len(places[tuple(flat[k : k + window].tolist())]) >= least}


@pytest.mark.parametrize("text", [[0], [1, 1, 1, 1, 0, 1, 1, 0], [3, 1, 2, 0, 0, 3, 1, 2, 0], [2] * 50 + [0] + [2] * 49 + [0]])
def test_suffix_array(text):
    text, cuts = np.array(text), iter(range(-len(text), 0))
    unlike = [next(cuts) if x == 0 else x for x in text.tolist()]
    assert substring.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: unlike[i:])


def test_other_columns_stay(make):
    docs = make([(None, "a b c d a b c d"), (2, "x")]).select("doc_id", "text", "source", "score")
    got = {r["doc_id"]: (r["kept"], r["source"]) for r in substring.remove_repeats(docs, 4).collect()}
    assert got == {None: ("", "s"), 2: ("x", "s")}
    assert substring.remove_repeats(docs.limit(0), 4).count() == 0


def test_a_third_of_the_rows_is_one_id_and_text(make, prose, monkeypatch):
    for name, value in (("BLOCK_BYTES", 3000), ("BUCKET_BYTES", 6000)):
        monkeypatch.setattr(substring, name, value)
    hot = "a hot text of nine words in every row"
    rows = [*enumerate(prose(60, 4, words=80)), *[(7, hot)] * 30, (99, f"before {hot} after")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(make(rows).select("doc_id", "text"), 9).collect()), key=str)
    assert got == brute(rows, 9)
