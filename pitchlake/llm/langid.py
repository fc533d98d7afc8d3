"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 code points) of the lower-cased text, each
by its share of the text's positions times its inverse document frequency.
Weights come from follow-the-regularised-leader steps with elastic-net
penalties, which leave most of them zero; a temperature fitted on a part kept
apart turns the outputs into calibrated probabilities.

Document frequencies are counted over all training rows, in one aggregate of
2 ** ``BITS`` groups. Weights are fitted on a bounded sample of labelled rows:
about ``SAMPLE_ROWS``, shared evenly among the languages, chosen by a hash of the
id and the text. Predicting covers every whole text; the weights (2 ** ``BITS``
rows, a column for each language) are broadcast and do not grow with the input.
More than ``MOST_LANGS`` different labels are an error, not a model.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and
so is every text if no row has a label; repeated rows count and predict each;
equal probabilities go to the language that comes first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, runs, tidied_batches

BITS = 16
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 4000
MOST_LANGS = 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.001
SCALE = 30.0
UNDETERMINED = "und"
RUN_BYTES = 2 << 20
PIECE = 1 << 20

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], "u4")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, two zeros after each, and where each text starts."""
    raw = [(t.lower() + "\0\0").encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 4 for r in raw], "i8")
    return np.frombuffer(b"".join(raw) + b"\0" * 8, "<u4"), np.cumsum(lengths) - lengths


def _features(codes: np.ndarray, order: int) -> np.ndarray:
    """The feature that starts at each place but the last two."""
    n = len(codes) - 2
    h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, "u4")
    with np.errstate(over="ignore"):
        for k in range(order):
            h ^= codes[k : n + k]
            h *= _FACTORS[k]
            h ^= h >> np.uint32(15)
        h *= _FACTORS[0]
    return h >> np.uint32(32 - BITS)


class Model:
    """Languages and, for each feature, its weights times its inverse document frequency."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray):
        self.langs, self.table, self.bias = langs, table, bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import regex

        letter = regex.compile(r"\p{L}").search
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if t and letter(t)] if self.langs else []
        if able:
            codes, starts = _codes([texts[i] for i in able])
            ends = np.append(starts, len(codes) - 2)
            sums = np.zeros((len(starts), len(self.langs)))
            for a in range(0, len(codes) - 2, PIECE):  # a very long text is more than one piece
                b = min(a + PIECE, len(codes) - 2)
                first, last = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b, "left")
                total = np.zeros((b - a, len(self.langs)), "f4")
                for order in ORDERS:
                    total += self.table[_features(codes[a : b + 2], order)]
                sums[first:last] += np.add.reduceat(total.astype("f8"), np.maximum(ends[first:last], a) - a, axis=0)
            out = sums / np.diff(ends)[:, None] + self.bias
            p = _softmax(out)
            for i, best, score in zip(able, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                langs[i], scores[i] = self.langs[best], score
        return langs, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sample_vectors(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Language, features and their shares of about ``rows`` rows of ``labelled`` (``doc_id``, ``text``, ``lang``)."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: the labels are no languages")
    if not counts:
        return []
    each = max(1, rows // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, tfs = [], []
            for t in batch.column("text").to_pylist():
                codes, _ = _codes([t])
                ids, n = np.unique(np.concatenate([_features(codes, o) for o in ORDERS]), return_counts=True)
                found.append(ids.astype("<u4").tobytes())
                tfs.append((n / (len(codes) - 2)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array(found, pa.binary()), pa.array(tfs, pa.binary())], names=["lang", "key", "ids", "tf"])

    chosen = labelled.where(place < share[F.col("lang")]).select("lang", F.xxhash64("text", "doc_id").alias("key"), "text")
    got = chosen.mapInArrow(tidied_batches(run), "lang string, key long, ids binary, tf binary").collect()
    return [(r["lang"], np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["tf"], "<f4").astype("f8")) for r in sorted(got, key=lambda r: (r["key"], r["lang"]))]


def document_frequencies(labelled: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows of ``labelled`` (``text``) there are, and how many of them have each feature; the driver gets 2 ** BITS counts at most."""
    d = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(d + 1, "i8")  # the last counts rows
        for batch in batches:
            for part in runs(batch, "text", RUN_BYTES // 8):  # a place is three keys of eight bytes here
                codes, starts = _codes(part.column("text").to_pylist())
                text = np.repeat(np.arange(len(starts), dtype="u8"), np.diff(np.append(starts, len(codes) - 2)))
                both = np.unique(np.concatenate([text << np.uint64(BITS) | _features(codes, o) for o in ORDERS]))
                seen[:d] += np.bincount((both & np.uint64(d - 1)).astype("i8"), minlength=d)
                seen[d] += part.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "n"])

    found = labelled.select("text").mapInArrow(tidied_batches(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(d + 1)
    for r in found:
        df[r["feature"]] = r["n"]
    return int(df[d]), df[:d]


def train(vectors: list[tuple[str, np.ndarray, np.ndarray]], rows: int, df: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Fit weights on four fifths of the vectors, in their order, and the temperature on the rest. df: document frequencies in ``rows`` texts."""
    langs = sorted({v[0] for v in vectors})
    d, c = 1 << BITS, len(langs)
    if not langs:
        return Model([], np.zeros((d, 0), "f4"), np.zeros(0))
    idf = np.log((1 + rows) / (1 + df)) + 1
    apart = [v for i, v in enumerate(vectors) if i % 5 == 4] or vectors
    fitted = [v for i, v in enumerate(vectors) if i % 5 != 4]
    z, n = np.zeros((d + 1, c)), np.zeros((d + 1, c))

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    def inputs(ids: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(ids, d).astype("i8"), np.append(tf * idf[ids] * SCALE, 1.0)

    for _ in range(epochs):
        for lang, ids, tf in fitted:
            at, x = inputs(ids, tf)
            w = weights(at)
            p = _softmax(x @ w)
            p[langs.index(lang)] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(np.arange(d + 1))
    outs, truth = [], []
    for lang, ids, tf in apart:
        at, x = inputs(ids, tf)
        outs.append(x @ w[at])
        truth.append(langs.index(lang))
    outs, truth = np.array(outs), np.array(truth)
    loss = {t: -np.log(np.maximum(_softmax(outs / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in np.exp(np.linspace(np.log(0.2), np.log(5), 41)).tolist()}
    t = min(loss, key=lambda k: (loss[k], abs(np.log(k))))
    return Model(langs, (w[:d] * idf[:, None] * SCALE / t).astype("f4"), w[d] / t)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``; these two names must be free."""
    if taken := {"lang_pred", "score"} & set(docs.columns):
        raise ValueError(f"the names {sorted(taken)} must be free")
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.langs, model.table, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in runs(batch, "text", RUN_BYTES):
                langs, scores = own.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(tidied_batches(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def fold(id_col: str = "doc_id"):
    """True for the rows kept out of training; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """The model of ``docs`` (``doc_id``, ``text``, ``lang``) outside the held-out fold."""
    prepare(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").where(~fold() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train(sample_vectors(labelled), *document_frequencies(labelled))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", fold().alias("held_out"))
    return predict(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
