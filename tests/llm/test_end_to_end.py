"""Each query by its registered name over the driver's smallest tables, against plain Python where there is a contract."""

import base64
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__

from . import test_fingerprint, test_pii, test_secrets
from .test_lm import model

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    return {r["doc_id"]: r for r in rows}


def ran(spark, name, columns):
    df = __spark_entry__.queries()[name](spark, DATA)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    return df.collect()


def sha(raw):
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def test_op1(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = ran(spark, "op1_byte_bpe", {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        ids = own.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text))


def test_op2(spark, docs):
    from pitchlake.llm import lm

    words = {i: [w.decode() for w in (r["text"] or "").encode().lower().split()] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts, n, p = model([words[i] for i in docs if not held[i]], lm.SMOOTHING)
    rows = ran(spark, "op2_lm_score", {"held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"})
    assert len(rows) == len(docs)
    for r in rows[::5]:
        seq = ["<s>", *words[r["doc_id"]], "</s>"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(seq) - 1, sum(counts[w,] > 0 for w in seq[1:]), n)
        assert r["base_score"] == pytest.approx(sum(np.log10(p(w, ())) for w in seq[1:]))
        assert r["score"] == pytest.approx(sum(np.log10(p(seq[j], tuple(seq[max(0, j - 2) : j]))) for j in range(1, len(seq))))


def test_op3(spark, docs):
    rows = ran(spark, "op3_secret_scan", {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"})
    assert len(rows) == len(docs)
    for r in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in test_secrets.brute(docs[r["doc_id"]]["text"] or "")]
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]


def test_op4(spark, docs):
    rows = ran(spark, "op4_length_buckets", {})
    assert {r["doc_id"] for r in rows} == set(docs)


def test_op5(spark, docs):
    kinds = ("email", "ip", "card", "phone")
    rows = ran(spark, "op5_contextual_pii", {f"n_{k}": "bigint" for k in kinds} | {"base_sha256": "string", "spans": "string"})
    assert len(rows) == len(docs)
    for r in rows:
        base = [f"{kinds[k]}:{a}:{b}" for k, a, b in test_pii.brute(docs[r["doc_id"]]["text"] or "")]
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in kinds] == [sum(x.startswith(k) for x in base) for k in kinds]


def test_op7(spark, docs):
    rows = ran(spark, "op7_language_id", {"held_out": "boolean", "lang_pred": "string", "score": "double"})
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    assert len(rows) == len(docs) and all(r["held_out"] == held[r["doc_id"]] for r in rows)
    judged = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] and any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")]
    assert len(judged) > 20 and np.mean(judged) > 0.95


def test_op9(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    good = [(r["vec_id"], np.array(r["embedding"], float)) for r in table if r["embedding"] is not None and len(r["embedding"]) and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    found: dict[int, set] = {}
    for r in ran(spark, "op9_learned_partitions", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}):
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    vectors = np.array([v for _, v in good])
    shares = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-s, i) for s, (i, _) in zip((vectors @ v).tolist(), good, strict=True) if i != q)[:20]
            shares.append(len(found[q] & {i for _, i in best}) / len(best))
            assert len(found[q]) == len(best)
    assert set(found) == {q for q, _ in good if q % 20 == 0} and np.mean(shares) >= 0.9


def test_op10(spark, docs):
    rows = ran(spark, "op10_paragraph_sketch", {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"})
    want = test_fingerprint.brute([(i, r["text"]) for i, r in docs.items()])
    assert len(rows) == len(docs)
    for r in rows:
        n, digest, edited, nxt = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest) and r["near_edited"] == pytest.approx(edited) and r["near_next"] == pytest.approx(nxt)


def test_pipeline(spark, docs):
    rows = ran(spark, "pipeline", {})
    assert rows and {r["doc_id"] for r in rows} <= set(docs)
