"""Ranked lexical search: hierarchical max trees over document ranges, best-first branch and bound.

Terms are maximal runs of ASCII letters and digits and of all characters beyond
ASCII; only A-Z are lower-cased. ``N``: documents with a term, ``L``: their terms,
``n``: those of one document, ``df``: documents that hold a term. A term weighs
``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document scores, for each term of the
item (repeats included), the weight times ``(10**9 * tf) div (1000 * tf + 8 * m)``,
with ``m = 100 - 75 + (75 * n * N) div L``. All but the logarithm is in integers.

*Index.* One pass reads all texts and writes shards of up to ``SHARD_BYTES`` of text:
ids and lengths of their documents and, for the terms that items ask for, who holds
them how often. Its aggregates give ``N``, ``L`` and ``df``.

*Search.* A shard's postings become, for each term, a tree of maxima: the most that
one document can score by it, in ranges of ``FANOUT`` documents, ranges of those, and
so on. An item opens the range of the highest summed bound first until its tenth
score is above every bound; a range whose bound equals the tenth score is opened
too, for a document of it may tie with a smaller id. The tenth score goes on from
shard to shard of a task; the best of all tasks meet in one ranking.

Items are taken in blocks of about ``BLOCK_BYTES`` of text, dealt by their place, so
what is broadcast has a bound; each block is a pass over the documents.

Edge cases: null or empty texts have no term, match nothing and count in nothing;
an item without terms, or whose terms occur nowhere, has no rows; an item of null
id stays; repeated items are ranked each, repeated documents stand each for itself
(equal ids next to each other); other columns do not matter; without documents
there are no rows; a very long text is read in slices of ``SLICE`` characters.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, runs, texts, tidied_batches

SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
FANOUT = 16
SLICE = 1 << 20
K = 10
#: Every byte that no term has becomes a space, A-Z become small.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    raw = (text or "").encode().translate(_TABLE)
    at = 0
    while len(raw) - at > SLICE and (end := raw.find(b" ", at + SLICE)) >= 0:
        yield raw[at:end].split()
        at = end
    yield raw[at:].split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """A shard: its documents in order, and for each asked term (by number) who holds it how often."""

    def __init__(self, ids: list, lengths: list[int], term: np.ndarray, doc: np.ndarray, tf: np.ndarray):
        self.ids, self.lengths, self.term, self.doc, self.tf = ids, np.array(lengths, "i8"), term, doc, tf

    @classmethod
    def of(cls, ids: list, found: list[str | None], number: dict[bytes, int]) -> Postings:
        lengths, term, doc, tf = [], [], [], []
        for i, text in enumerate(found):
            n, counts = 0, Counter()
            for words in terms(text):
                n += len(words)
                counts.update(map(number.get, words))
            counts.pop(None, None)
            lengths.append(n)
            term += counts.keys()
            tf += counts.values()
            doc += [i] * len(counts)
        term, doc, tf = (np.array(x, "i8") for x in (term, doc, tf))
        order = np.argsort(term, kind="stable")
        return cls(ids, lengths, term[order], doc[order], tf[order])


class MaxTree:
    """Maxima, for each term, of what documents in ranges of ``FANOUT`` to the power of the level can score by it.

    Documents stand in the order of their lengths, which makes those of one range alike.
    A level's entries (term, place, maximum) stand by the range above them, so that
    opening a range reads one stretch of the level.
    """

    def __init__(self, p: Postings, n_docs: int, n_terms: int):
        m = 25 + (75 * p.lengths * n_docs) // max(1, n_terms)
        share = (1_000_000_000 * p.tf) // (1000 * p.tf + 8 * m[p.doc])
        self.places = np.argsort(p.lengths, kind="stable")
        at = np.empty(len(self.places), "i8")
        at[self.places] = np.arange(len(at))
        self.terms, row = np.unique(p.term, return_inverse=True)
        self.levels = []
        self._add(row, at[p.doc], share, len(p.ids))
        while self.sizes[-1] > FANOUT:
            row, at, top = self.levels[-1][1:]
            size = -(-self.sizes[-1] // FANOUT)
            key = row * size + at // FANOUT
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            self._add(row[order][starts], key[order][starts] % size, np.maximum.reduceat(top[order], starts) if len(starts) else top, size)

    @property
    def sizes(self) -> list[int]:
        return [size for size, *_ in self._stretches]

    def _add(self, row: np.ndarray, at: np.ndarray, top: np.ndarray, size: int) -> None:
        above = at // FANOUT
        order = np.argsort(above, kind="stable")
        starts = np.searchsorted(above[order], np.arange(-(-size // FANOUT) + 1))
        if not self.levels:
            self._stretches = []
        self._stretches.append((size, starts.tolist()))
        self.levels.append((size, row[order], at[order], top[order]))

    def factors(self, asked: list[tuple[int, int]]) -> np.ndarray | None:
        """What each term's maxima count for an item (weight times repeats), or nothing if it asks for none of them."""
        if not len(self.terms) or not asked:
            return None
        terms, values = np.array(asked, "i8").T
        where = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = (self.terms[where] == terms) & (values > 0)
        if not here.any():
            return None
        out = np.zeros(len(self.terms), "i8")
        out[where[here]] = values[here]
        return out

    def opened(self, factors: np.ndarray, level: int, above: int) -> np.ndarray:
        """Summed bounds (on level 0: scores) of what lies in range ``above`` of the level over it."""
        size, row, at, top = self.levels[level]
        starts = self._stretches[level][1]
        a, b = starts[above], starts[above + 1]
        out = np.zeros(min(FANOUT, size - above * FANOUT), "i8")
        np.add.at(out, at[a:b] - above * FANOUT, factors[row[a:b]] * top[a:b])
        return out


def best(tree: MaxTree, ids: list, asked: list[tuple[int, int]], k: int, least: int = 0) -> tuple[list[tuple[int, int]], int]:
    """The documents of a shard that an item ranks first, as (score, place), and how many ranges were opened.

    asked: terms and their factors (weight times repeats). least: a score that k documents
    elsewhere reach; below it nothing is of use, equal to it a smaller id may be.
    """
    factors = tree.factors(asked)
    if factors is None:
        return [], 0
    found: list[tuple[int, tuple, int]] = []  # a heap with the worst of the k best on top
    queue: list[tuple[int, int, int]] = []
    opened = 0

    def push(level: int, above: int) -> None:
        sums = tree.opened(factors, level, above)
        floor = max(least, found[0][0] if len(found) == k else 0, 1)
        for i in np.flatnonzero(sums >= floor).tolist():
            heapq.heappush(queue, (-int(sums[i]), level, above * FANOUT + i))

    push(len(tree.levels) - 1, 0)
    while queue:
        bound, level, at = heapq.heappop(queue)
        if -bound < (found[0][0] if len(found) == k else 1):
            break
        if level == 0:
            place = int(tree.places[at])
            entry = (-bound, _last(ids[place]), place)
            if len(found) < k:
                heapq.heappush(found, entry)
            elif entry[:2] > found[0][:2]:
                heapq.heapreplace(found, entry)
        else:
            opened += 1
            push(level - 1, at)
    return [(score, at) for score, _, at in found], opened


def _last(doc_id) -> tuple:
    """Orders ids from the last to the first; null ids come last of all."""
    return (False, 0) if doc_id is None else (True, _Reversed(doc_id))


class _Reversed:
    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        return self.value == other.value

    def __lt__(self, other):
        return self.value > other.value


def item_blocks(items: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[int]]:
    """A written table of items with ``block`` and ``item`` (a number of its own), and the blocks; a block has about ``block_bytes`` of text."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, n = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            for piece in runs(batch, "text", block_bytes):
                if held and held + piece.nbytes > block_bytes:
                    block, held = block + 1, 0
                held += piece.nbytes
                yield piece.append_column("block", pa.array([part + block] * piece.num_rows)).append_column("item", pa.array(range(part + n, part + n + piece.num_rows)))
                n += piece.num_rows

    kind = items.schema["item_id"].dataType.simpleString()
    dealt = items.repartition(max(1, -(-size // block_bytes))).mapInArrow(deal, f"item_id {kind}, text string, block long, item long")
    dealt.write.parquet(f"{folder}/items")
    table = items.sparkSession.read.parquet(f"{folder}/items")
    return table, sorted(r["block"] for r in table.select("block").distinct().collect())


def index(docs: DataFrame, number: dict[bytes, int], folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A written table of shards (``doc_id``, ``text``): documents, postings and counts of the terms in ``number``."""
    shared = docs.sparkSession.sparkContext.broadcast(number)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids, parts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            base, lengths, columns = 0, [], []
            for p in parts:
                columns.append((p.term, p.doc + base, p.tf))
                lengths += p.lengths.tolist()
                base += len(p.ids)
            term, doc, tf = (np.concatenate(x) for x in zip(*columns, strict=True))
            order = np.argsort(term, kind="stable")
            values = [x[order].astype("i4") for x in (term, doc, tf)]
            return pa.RecordBatch.from_pydict({"ids": [ids], "lengths": [lengths], "term": [values[0]], "doc": [values[1]], "tf": [values[2]]}, schema=_schema(kind_type))

        kind_type = None
        for batch in batches:
            kind_type = batch.schema.field("doc_id").type
            for piece in runs(batch, "text", SLICE):
                if ids and size + piece.nbytes > shard_bytes:
                    yield flush()
                    ids, parts, size = [], [], 0
                own = piece.column("doc_id").to_pylist()
                parts.append(Postings.of(own, piece.column("text").to_pylist(), known))
                ids += own
                size += piece.nbytes
        if ids:
            yield flush()

    docs.mapInArrow(tidied_batches(read), f"ids array<{kind}>, lengths array<long>, term array<int>, doc array<int>, tf array<int>").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("term", "doc", "tf"))])


def search_block(shards: DataFrame, asked: list[tuple[int, Counter]], k: int) -> DataFrame:
    """``item``, ``doc_id``, ``score`` of each item's best in all shards (more than k an item: the best of each task). asked: items by number and their terms."""
    spark = shards.sparkSession
    n_docs, n_terms = shards.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["count"] for r in shards.select(F.explode("term").alias("t")).groupBy("t").count().collect()}  # of the block's terms, which are bounded
    items = [(item, [(t, times * weight(n_docs, df[t])) for t, times in sorted(counts.items()) if t in df]) for item, counts in asked]
    shared = spark.sparkContext.broadcast(items)
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, list] = {}
        kind_type = None
        for batch in batches:
            kind_type = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].as_py()
                p = Postings(ids, batch.column("lengths")[i].values.to_numpy(), *(batch.column(c)[i].values.to_numpy().astype("i8") for c in ("term", "doc", "tf")))
                tree = MaxTree(p, n_docs, n_terms)
                for item, own in shared.value:
                    held = tops.setdefault(item, [])
                    new, _ = best(tree, ids, own, k, held[-1][0] if len(held) == k else 0)
                    if new:
                        tops[item] = sorted([*held, *((s, ids[at]) for s, at in new)], key=lambda x: (x[0], _last(x[1])), reverse=True)[:k]
        if kind_type is not None:
            rows = [(item, s, d) for item, held in tops.items() for s, d in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind_type), pa.array([r[1] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return shards.mapInArrow(tidied_batches(run), f"item long, doc_id {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's k best documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = prepare(docs.sparkSession)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/search-{uuid.uuid4().hex}"
    table, blocks = item_blocks(items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")), folder)
    own = texts(docs, id_col, text_col)
    parts = []
    for j, block in enumerate(blocks):
        asked, number = [], {}
        for r in table.where(F.col("block") == block).select("item", "text").collect():
            counts = Counter(number.setdefault(w, len(number)) for words in terms(r["text"]) for w in words)
            if counts:
                asked.append((r["item"], counts))
        parts.append(search_block(index(own, number, f"{folder}/shards-{j}"), asked, k))
    kind = dict(own.dtypes)["doc_id"]
    found = spark.createDataFrame([], f"item long, doc_id {kind}, score long")
    for part in parts:
        found = found.unionByName(part)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best_ = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return table.select("item", "item_id").join(best_, "item").select("item_id", "rank", "doc_id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that each item of ``benchmark`` ranks first."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
