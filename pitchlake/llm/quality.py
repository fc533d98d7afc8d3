"""Quality scores: histogram gradient-boosted trees over document statistics.

*Statistics.* One pass reads every whole text: shares of character classes and of
pairs of neighbouring ones, lengths of words, lines and sentences, how varied and how
repetitive words and lines are. They depend on the text alone and are written as a
table of ``FEATURES`` numbers a document, from which both steps below read.

*Training.* About ``SAMPLE_ROWS`` labelled rows outside the held-out fold, shared
evenly between both labels and chosen by a hash of the id, are binned by their
quantiles; trees grow level by level on sums of gradients by bin. Weights undo the even
shares (they come from counts over all training labels), a fifth of the sample tells
how many trees to keep.

*Scoring.* Trees are flattened into arrays (feature, threshold, children, value); all
rows of a batch go down all trees at once, level by level. The arrays are broadcast
(at most ``TREES * 2 ** (DEPTH + 1)`` nodes).

Edge cases: null and empty texts have zeros for statistics and get a score as others
do; labels that are null or neither 0 nor 1 are no labels, a document labelled both
ways counts as both; repeated labels count once, repeated documents are scored each;
without labels every score is 0.5; null ids have no label; other columns do not matter;
an empty table gives no rows; a very long text is read in slices of ``SLICE`` bytes.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, runs, texts, tidied_batches

SAMPLE_ROWS = 8000
TREES, DEPTH, BINS = 100, 4, 64
RATE, L2, LEAST_WEIGHT = 0.1, 1.0, 5.0
THRESHOLD = 0.7
SLICE = 1 << 20
#: Words whose variety is judged together, so that it does not depend on the text's length.
SEGMENT = 256

_GROUPS = [" ", "\n", "\t\r\x0b\x0c", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".", ",", "!?", "\"'`", "()[]{}<>", "*#$%&@^~", "|", "-_=+/\\", ":;"]
#: Then control characters, first bytes and further bytes of characters beyond ASCII.
CONTROL, FIRST, FURTHER = len(_GROUPS), len(_GROUPS) + 1, len(_GROUPS) + 2
CLASSES = len(_GROUPS) + 3
_CLASS = np.array([FURTHER if 128 <= b < 192 else FIRST if b >= 192 else next((i for i, g in enumerate(_GROUPS) if chr(b) in g), CONTROL) for b in range(256)], "u1")
#: Coarse classes, of which neighbours are counted: white space, capitals, other letters, digits, sentence marks, other marks.
COARSE = 6
_COARSE = np.array([0, 0, 0, 1, 2, 3, 4, 4, 4, *[5] * 6, 5, 2, 2], "u1")
WORDS = ("words", "longest", "variety", "echo", "capitalised", "lines", "line_variety", "sentence")
FEATURES = CLASSES - 1 + COARSE**2 + 2 + len(WORDS)


def _letters(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text counts of classes, and of neighbours of coarse classes. ends: where texts end in ``data``."""
    n = len(ends)
    single, pairs = np.zeros(n * CLASSES, "i8"), np.zeros(n * COARSE**2, "i8")
    for a in range(0, len(data), SLICE):
        b = min(a + SLICE, len(data))
        kind = _CLASS[data[a : b + 1]]
        at = np.arange(a, b)
        text = np.searchsorted(ends, at, "right")
        single += np.bincount(text * CLASSES + kind[: b - a], minlength=len(single))
        coarse = _COARSE[kind].astype("i8")
        inner = (at + 1 < ends[text])[: len(coarse) - 1]
        pairs += np.bincount((text[: len(inner)] * COARSE**2 + coarse[: len(inner)] * COARSE + coarse[1 : len(inner) + 1])[inner], minlength=len(pairs))
    return single.reshape(n, CLASSES), pairs.reshape(n, COARSE**2)


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE and (end := text.find(" ", at + SLICE)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


def _words(text: str) -> tuple[float, ...]:
    """The statistics named in ``WORDS``."""
    n = longest = echoes = capital = lines = different = segments = 0
    variety = 0.0
    for part in _slices(text):
        words = part.split()
        n += len(words)
        longest = max(longest, max(map(len, words), default=0))
        echoes += sum(map(operator.eq, words, words[1:]))
        capital += sum(map(str.istitle, words))
        for i in range(0, len(words), SEGMENT):
            some = words[i : i + SEGMENT]
            variety += len(set(some)) / len(some) * len(some)
        segments += len(words)
        own = part.split("\n")
        lines += len(own)
        different += len(set(own))
    each = lambda x, y: x / y if y else 0.0
    return np.log1p(n), np.log1p(longest), each(variety, segments), each(echoes, n), each(capital, n), each(lines, n), each(different, lines) if n else 0.0, np.log1p(each(n, 1 + text.count(".")))


def statistics(found: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text."""
    raw = [(t or "").encode() for t in found]
    ends = np.cumsum([len(r) for r in raw])
    single, pairs = _letters(np.frombuffer(b"".join(raw), "u1"), ends)
    chars = single[:, :FURTHER].sum(axis=1, keepdims=True)
    letters = single[:, [3, 4, FIRST]].sum(axis=1, keepdims=True)
    share = lambda x, y: x / np.maximum(y, 1)
    words = np.array([_words(t or "") for t in found]).reshape(len(raw), len(WORDS))
    return np.hstack([share(single[:, :FURTHER], chars), share(pairs, pairs.sum(axis=1, keepdims=True)), np.log1p(chars), share(single[:, [3]], letters), words]).astype("f4")


@dataclass
class Forest:
    """Flattened trees: node ``i`` sends a row to ``left[i]`` if its feature is at most the threshold, else to ``right[i]``; leaves send rows to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        out = np.full(len(x), self.base)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            row, node = np.arange(len(part))[:, None], np.tile(self.roots, (len(part), 1))
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[a : a + 4096] += self.value[node].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _chance(self.raw(x))


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each feature the thresholds between its bins: different quantiles."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at, method="lower")) for c in x.T]


def grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, bins: int, depth: int = DEPTH) -> tuple[list[list], np.ndarray]:
    """One tree: nodes [feature, bin, left, right, value] with children by number, and each row's leaf.

    The best split of a node has the highest gain; of equal ones the first feature and bin.
    """
    n, d = binned.shape
    nodes, at, open_ = [[0, bins, 0, 0, 0.0]], np.zeros(n, "i8"), [0]
    slot = binned + np.arange(d) * bins
    for level in range(depth + 1):
        place = np.full(len(nodes), -1)
        place[open_] = np.arange(len(open_))
        live = np.flatnonzero(place[at] >= 0)
        key = (place[at[live]][:, None] * (d * bins) + slot[live]).ravel()
        size = len(open_) * d * bins
        g, h = (np.bincount(key, np.repeat(v[live], d), size).reshape(len(open_), d, bins) for v in (gradient, hessian))
        total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
        for i, node in enumerate(open_):
            nodes[node] = [0, bins, node, node, -RATE * total_g[i] / (total_h[i] + L2)]
        if level == depth:
            break
        left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
        right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
        gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - (total_g**2 / (total_h + L2))[:, None, None]
        gain[(left_h < LEAST_WEIGHT / 4) | (right_h < LEAST_WEIGHT / 4)] = -1.0
        flat = gain.reshape(len(open_), -1)
        best = flat.argmax(axis=1)
        grown = []
        for i, node in enumerate(open_):
            if flat[i, best[i]] > 1e-6:
                f, b = divmod(int(best[i]), bins - 1)
                nodes[node][:4] = [f, b, len(nodes), len(nodes) + 1]
                grown += [len(nodes), len(nodes) + 1]
                nodes += [[0, bins, 0, 0, 0.0], [0, bins, 0, 0, 0.0]]
        if not grown:
            break
        table = np.array([x[:4] for x in nodes], "i8")
        at = np.where(binned[np.arange(n), table[at, 0]] <= table[at, 1], table[at, 2], table[at, 3])
        open_ = grown
    return nodes, at


def fit(x: np.ndarray, label: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosted trees on rows in their order: each fifth row is kept apart and tells how many trees are best."""
    prior = np.array([(weight * (label == c)).sum() for c in (0, 1)]) + 1.0
    base, edges = float(np.log(prior[1] / prior[0])), cuts(x, bins) if len(x) else []
    apart = np.arange(len(x)) % 5 == 4
    if len(x) < 50 or len(set(label[~apart].tolist())) < 2:
        trees = 0
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1) if trees else np.zeros((len(x), 0), "i8")
    odds, grown, loss = np.full(len(x), base), [], []
    own = np.flatnonzero(~apart)
    for _ in range(trees):
        p = _chance(odds)
        nodes, _ = grow(binned[own], (weight * (p - label))[own], (weight * p * (1 - p))[own], bins, depth)
        grown.append(nodes)
        table = np.array([n[:4] for n in nodes], "i8")
        at = np.zeros(len(x), "i8")
        for _ in range(depth):
            at = np.where(binned[np.arange(len(x)), table[at, 0]] <= table[at, 1], table[at, 2], table[at, 3])
        odds += np.array([n[4] for n in nodes])[at]
        p = np.clip(_chance(odds[apart]), 1e-9, 1 - 1e-9)
        loss.append(float(-(weight[apart] * np.where(label[apart] == 1, np.log(p), np.log(1 - p))).sum()))
    grown = grown[: 1 + int(np.argmin(loss))] if loss else []
    starts = np.cumsum([0, *(len(t) for t in grown)])[: len(grown)]
    rows = [(f, edges[f][b] if b < len(edges[f]) else np.inf, a + left, a + right, v) for a, nodes in zip(starts.tolist(), grown, strict=True) for f, b, left, right, v in nodes]
    feature, threshold, left, right, value = (np.array(c, kind) for c, kind in zip(zip(*rows, strict=True), ("i4", "f4", "i4", "i4", "f8"), strict=True)) if rows else (np.zeros(0, k) for k in ("i4", "f4", "i4", "i4", "f8"))
    return Forest(base if len(x) else 0.0, starts.astype("i4"), feature, threshold, left, right, value, depth)


def fold(id_col: str = "doc_id"):
    """True for the rows kept out of training; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """A written table of ``doc_id``, ``held_out`` and ``x`` (the statistics) of ``docs`` (``doc_id``, ``text``)."""
    spark = prepare(docs.sparkSession)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/quality-{uuid.uuid4().hex}"
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text", SLICE):
                x = statistics(part.column("text").to_pylist())
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), values], names=["doc_id", "held_out", "x"])

    docs.withColumn("held_out", fold()).mapInArrow(tidied_batches(run), f"doc_id {kind}, held_out boolean, x array<float>").write.parquet(folder)
    return spark.read.parquet(folder)


def sample(table: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, labels and weights of about ``rows`` training rows. labels: ``doc_id`` and ``quality``."""
    known = labels.where(~fold() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    found: list[tuple[float, list]] = []
    for quality in sorted(counts):
        order = F.xxhash64("doc_id")
        few = known.where(F.col("quality") == quality).orderBy(order, "doc_id").limit(rows // 2)  # rows // 2 ids at most: small enough to be broadcast
        own = table.join(F.broadcast(few), "doc_id").select(order.alias("h"), "x").orderBy("h", F.xxhash64("x")).limit(rows // 2).collect()
        found += [(r["h"], r["x"], quality, counts[quality] / len(own)) for r in own]
    found.sort(key=operator.itemgetter(0, 2, 1))
    weight = np.array([r[3] for r in found])
    return np.array([r[1] for r in found], "f4").reshape(len(found), FEATURES), np.array([r[2] for r in found], "i8"), weight / weight.mean() if len(found) else weight


def predict(table: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of a table of statistics."""
    shared = table.sparkSession.sparkContext.broadcast(forest)
    kind = dict(table.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("x").flatten().to_numpy().reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype("i4"))], names=["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The quality of every text of ``docs``, learned from ``labels`` (``doc_id``, ``quality``)."""
    table = described(texts(docs, id_col, text_col))
    return predict(table, fit(*sample(table, labels)))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text of ``documents``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
