import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchlake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_like_tiktoken(codec, reference, texts):
    got = codec.encode(texts)
    assert [ids(x) for x in got] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_long_words(codec, reference):
    rng = np.random.default_rng(1)
    for n in (47, 48, 49, 513, 3000):
        word = "".join(rng.choice(list("abcdeth"), n))
        assert ids(codec.encode([word])[0]) == reference.encode_ordinary(word)
    for run in ("-" * 20_001, "=" * 4999, "ab" * 3000, " " * 7777, "aab" * 100):
        assert ids(codec.encode([run])[0]) == reference.encode_ordinary(run)


def test_both_queries_agree(codec, prose):
    pieces = [w.encode() for t in prose(30, words=80) for w in t.split()] + [b"hello" * 9, b"aaaaaaa"]
    assert codec._contract(pieces, bpe._ENCODE) == codec._contract(pieces, bpe._ENCODE_LONG)


def test_many_long_pretokens(codec, reference):
    rng = np.random.default_rng(2)
    cjk = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 160))) for _ in range(5000)]
    thai = ["".join(map(chr, rng.integers(0x0E01, 0x0E2E, 160))) for _ in range(500)]
    ascii_ = ["".join(map(chr, rng.integers(97, 123, 500))) for _ in range(20_000)]
    for words in (cjk, thai, ascii_):
        text = " ".join(words)
        assert ids(codec.encode([text])[0]) == reference.encode_ordinary(text)


def test_repeated_rows(spark, make, reference):
    rows = bpe.encode(make([(3, "the same"), (3, "the same"), (None, "x"), (None, None)]), PATH, P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), ids(bytes(r["ids"]))) for r in rows) == sorted((str(i), reference.encode_ordinary(t)) for i, t in ((3, "the same"), (3, "the same"), (None, "x"), (None, "")))


def test_cache_may_be_small(codec, reference, monkeypatch, prose):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    for t in prose(20, words=60):
        assert ids(codec.encode([t])[0]) == reference.encode_ordinary(t)


def test_documents(spark, make, odd, reference):
    docs = make(list(enumerate(odd)))
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert len(rows) == len(odd)
    for i, t in enumerate(odd):
        assert ids(bytes(rows[i]["ids"])) == reference.encode_ordinary(t or "") and bytes(rows[i]["decoded"]) == (t or "").encode()
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_unknown_id(codec):
    with pytest.raises(ValueError):
        codec.decode([np.array([60_000], "<u4").tobytes()])
