"""Exact counts of word n-grams for documents in blocks, without a row for each n-gram.

Documents fall into blocks by a hash of their places. A block sends each of ``n_buckets`` hash
ranges the sorted distinct keys that it needs, packed, with its own counts; a
range adds up what all blocks sent and answers each with the totals, in the
order of the request; the block, whose documents are at hand again, goes on
with them. A block's documents travel as compressed Arrow data, packed where they
are read. Every document, block and range is a row or a few, so a frequent key
is one entry for each block, never a hot group. Sizes of blocks and ranges are
bounded by parameters; their numbers grow with the input.

A row goes from each block to at most ``FAN`` groups of ranges. With more ranges
than that, ``FAN`` blocks and one group meet in a cell, which adds up their
requests, asks the group's ranges for all of them, and shares the answers out
again: rows then grow in proportion to the input, not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, tidied, tidied_batches, tidied_pair

U = np.uint64
#: The most groups of ranges that a block sends rows to, and the blocks of a cell.
FAN = 4096
#: Of the holders of a key, so many at most ask the same one (see ``holders`` in ``counted``).
ARITY = 16
#: Bytes of documents that a task packs at a time.
PACKED_BYTES = 8 << 20
_BASE = U(0xC2B2AE3D27D4EB4F)
_BASE_INVERSE = U(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_A, _B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones, by one sort (``np.unique`` alone goes by a hash table, and the keys would be looked up again)."""
    order = np.argsort(keys)
    out = np.empty(len(keys), "i8")
    out[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) != 0)
    return out


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """64-bit hash of pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = a * _A + b
        x ^= x >> U(29)
        x *= _B
        x ^= x >> U(32)
    return x


@dataclass
class Words:
    """The words of a block's texts: for each word the place of its string in ``vocabulary``."""

    ids: np.ndarray
    lengths: np.ndarray
    vocabulary: list[bytes]
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        """Words are separated by ASCII white space, as ``bytes.split`` does."""
        import xxhash

        if not texts:
            return cls(np.zeros(0, "i4"), np.zeros(0, "i8"), [], np.zeros(0, "u8"))
        raw = pa.array(texts, pa.large_binary())
        lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers()))  # bytes, whatever they encode: no word is a Python object
        inside = pc.binary_length(lists.values).to_numpy() > 0  # white space at an end of a text leaves an empty piece
        lengths = np.diff(np.concatenate([[0], np.cumsum(inside)])[lists.offsets.to_numpy()])
        coded = lists.values.filter(pa.array(inside)).dictionary_encode()
        known = coded.dictionary
        _, offsets, data = known.buffers()
        offsets = np.frombuffer(offsets, "<i8", len(known) + 1, 8 * known.offset).tolist() if len(known) else [0]
        data = data.to_pybytes() if data is not None else b""
        vocabulary = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], "u8")
        return cls(coded.indices.to_numpy(zero_copy_only=False).astype("i4", copy=False), lengths.astype("i8", copy=False), vocabulary, hashes)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words of one document, and how many each document has."""
        counts = np.maximum(self.lengths - n + 1, 0)
        if not counts.any():
            return np.zeros(0, "u8"), counts
        h = self.hashes[self.ids]
        out = np.full(len(h) - n + 1, n, "u8")
        for k in range(n):
            out = mixed(out, h[k : len(h) - n + 1 + k])
        return out[self.gram_places(n)], counts

    def windows(self, n: int) -> np.ndarray:
        """Hashes of the same runs, for long n: differences of sums of hashes times powers."""
        if not len(self.ids):
            return np.zeros(0, "u8")
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[U(1)], np.full(len(self.ids) - 1, _BASE)]))
            inverse = np.cumprod(np.concatenate([[U(1)], np.full(len(self.ids) - 1, _BASE_INVERSE)]))
            sums = np.concatenate([[U(0)], np.cumsum(self.hashes[self.ids] * powers)])
            at = self.gram_places(n)
            return mixed((sums[at + n] - sums[at]) * inverse[at], U(n))

    def gram_places(self, n: int) -> np.ndarray:
        """Where those runs start among all words."""
        counts = np.maximum(self.lengths - n + 1, 0)
        total = int(counts.sum())
        return np.arange(total) + np.repeat(self.starts - (np.cumsum(counts) - counts), counts)


@dataclass
class Plan:
    """How many blocks and ranges, and how many leading bits of a key travel."""

    n_blocks: int
    n_buckets: int
    bits: int = 64
    fan: int = FAN

    @classmethod
    def fit(cls, size: int, block_bytes: int, bucket_bytes: int, spare: int = 64, least: int = 32) -> Plan:
        """For texts of ``size`` bytes. spare: 2 ** spare times as many keys as bytes exist (2 ** least keys at least), so that few meet by chance."""
        bits = min(64, max(least, math.ceil(math.log2(max(size, 2))) + spare))
        return cls(blocks_for(size, block_bytes), blocks_for(size, bucket_bytes), bits, FAN)

    @property
    def span(self) -> int:
        """Ranges of one group."""
        return math.ceil(self.n_buckets / self.fan)

    @property
    def rows(self) -> int:
        """The most rows that requests take."""
        if self.span == 1:
            return self.n_blocks * self.n_buckets
        return self.n_blocks * math.ceil(self.n_buckets / self.span) + math.ceil(self.n_blocks / self.fan) * self.n_buckets

    def cut(self, keys: np.ndarray) -> np.ndarray:
        """What travels of a key."""
        return keys >> U(64 - self.bits)

    def bucket(self, cut: np.ndarray) -> np.ndarray:
        """The range of each travelling key."""
        return (((cut << U(64 - self.bits)) >> U(32)) * U(self.n_buckets)) >> U(32)


def dealt(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` with ``block``, by the place of a row in what is read: equal rows, however many, spread over all blocks.

    A row must keep its place when it is read again, so ``docs`` come from files or a checkpoint, by narrow steps.
    """
    return docs.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(plan.n_blocks).cast("long")))


def in_blocks(docs: DataFrame, plan: Plan) -> DataFrame:
    """``block`` and ``rows``: ``docs`` (``doc_id``, ``text`` and more) dealt, if they are not yet, and packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting)
            blocks = table.column("block").to_numpy()
            order = np.argsort(blocks, kind="stable")
            table, blocks = table.take(pa.array(order)).drop_columns(["block"]).combine_chunks(), blocks[order]
            edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(blocks[edges[:-1]]), pa.array([_closed(table.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["block", "rows"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(x.nbytes for x in waiting) >= PACKED_BYTES:
                yield flush()
                waiting.clear()
        if waiting:
            yield flush()

    return (docs if "block" in docs.columns else dealt(docs, plan)).mapInArrow(tidied_batches(pack), "block long, rows binary")


def _closed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def sorted_block(table: pa.Table) -> pa.Table:
    """A block's documents in an order of their own, whatever order they arrived in (a recomputed task may see another)."""
    parts = [pa.ipc.open_stream(pa.py_buffer(raw.as_buffer())).read_all() for raw in table.column("rows")]
    return pa.concat_tables(parts).combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def shut(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def opened(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each, compressed; those of 255 and more follow in eight bytes."""
    return shut(np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<u8").tobytes())


def unpacked(raw: bytes, n: int) -> np.ndarray:
    raw = opened(raw)
    out = np.frombuffer(raw, "u1", n).astype("i8")
    out[out == 255] = np.frombuffer(raw, "u1", offset=n).view("<u8").astype("i8")
    return out


def coded(keys: np.ndarray) -> bytes:
    """Ascending keys as differences of the cheapest width, told by the first byte; wider ones follow in eight bytes.

    Bytes of one rank stand together, so that those of high ranks compress.
    """
    gaps = np.diff(keys, prepend=U(0))
    wide = [int(np.count_nonzero(gaps >= U((1 << 8 * w) - 1))) for w in range(1, 8)] + [0]
    width = min(range(1, 9), key=lambda w: len(gaps) * w + 8 * wide[w - 1])
    most = U((1 << 8 * width) - 1) if width < 8 else U(2**64 - 1)
    planes = np.ascontiguousarray(np.minimum(gaps, most).astype("<u8").view("u1").reshape(-1, 8)[:, :width].T)
    return shut(bytes([width]) + planes.tobytes() + (gaps[gaps >= most].astype("<u8").tobytes() if width < 8 else b""))


def decoded(raw: bytes, n: int) -> np.ndarray:
    raw = opened(raw)
    width = raw[0]
    gaps = np.zeros((n, 8), "u1")
    gaps[:, :width] = np.frombuffer(raw, "u1", n * width, 1).reshape(width, n).T
    gaps = gaps.view("<u8").ravel()
    if width < 8:
        gaps[gaps == U((1 << 8 * width) - 1)] = np.frombuffer(raw, "u1", offset=1 + n * width).view("<u8")
    return np.cumsum(gaps, dtype="u8")


Ask = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
Finish = Callable[[pa.Table, int, np.ndarray], pa.Table]

_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("who", pa.binary())])
_REQUESTS = "bucket int, block long, n int, keys binary, counts binary, who binary"
_REPLIES = "block long, bucket int, n int, told binary"


def _told(holders: bool, totals: np.ndarray, parents: np.ndarray) -> bytes:
    """An answer: the totals, or which keys occur twice and more and whom to ask about these."""
    if not holders:
        return packed(totals)
    again = totals >= 2
    return shut(np.packbits(again).tobytes() + parents[again].astype("<i4").tobytes())


def _heard(holders: bool, raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals (or 2 and 1 for keys that occur again and others), and parents (or none)."""
    if not holders:
        return unpacked(raw, n), np.zeros(0, "i8")
    raw = opened(raw)
    again = np.unpackbits(np.frombuffer(raw, "u1", -(-n // 8)), count=n).astype(bool)
    parents = np.full(n, -1)
    parents[again] = np.frombuffer(raw, "u1", offset=-(-n // 8)).view("<i4")
    return again + 1, parents


def _hear(holders: bool, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All answers of one asker, in the order of its keys."""
    rows = sorted(zip(*(replies.column(c).to_pylist() for c in ("bucket", "told", "n")), strict=True))
    parts = [_heard(holders, raw, n) for _, raw, n in rows]
    return tuple(np.concatenate([np.zeros(0, "i8"), *x]) for x in (zip(*parts, strict=True) if parts else ((), ())))


def _sent(plan: Plan, keys: np.ndarray, counts: np.ndarray, who: np.ndarray | None, unit: int, block: int) -> pa.Table:
    """Requests for ascending keys: a row for each group of ``unit`` ranges that has some."""
    groups = plan.bucket(keys).astype("i8") // unit
    edges = np.flatnonzero(np.diff(groups, prepend=-1, append=-2)) if len(keys) else np.zeros(1, "i8")
    rows: dict[str, list] = {name: [] for name in _REQUEST.names}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        values = (int(groups[a]), block, b - a, coded(keys[a:b]), packed(counts[a:b]), None if who is None else who[a:b].astype("<i4").tobytes())
        for name, value in zip(rows, values, strict=True):
            rows[name].append(value)
    return pa.table(rows, schema=_REQUEST)


class _Met:
    """The requests that meet in a range or cell: equal keys side by side, askers in an order by a hash of their numbers."""

    def __init__(self, table: pa.Table):
        blocks = table.column("block").to_numpy()
        self.table = table = table.take(pa.array(np.lexsort((blocks, mixed(blocks.astype("u8"), U(17))))))
        self.sizes = table.column("n").to_pylist()
        self.blocks = table.column("block").to_pylist()
        raw = lambda c: zip(table.column(c).to_pylist(), self.sizes, strict=True)
        keys = np.concatenate([decoded(x, n) for x, n in raw("keys")])
        counts = np.concatenate([unpacked(x, n) for x, n in raw("counts")])
        self.order = np.argsort(keys, kind="stable")
        keys = keys[self.order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.starts, self.group = np.flatnonzero(first), np.cumsum(first) - 1
        self.keys, self.sums = keys[self.starts], np.add.reduceat(counts[self.order], self.starts)

    def who(self) -> np.ndarray:
        """The block behind each sorted key."""
        parts = [np.full(n, b) if w is None else np.frombuffer(w, "<i4") for w, n, b in zip(self.table.column("who").to_pylist(), self.sizes, self.blocks, strict=True)]
        return np.concatenate(parts)[self.order]

    def parents(self, of_first: np.ndarray | int = -1) -> np.ndarray:
        """Of each sorted key's askers all but the first are told another to ask, at most ARITY the same."""
        who, start = self.who(), self.starts[self.group]
        i = np.arange(len(who)) - start
        return np.where(i > 0, who[start + np.maximum(i - 1, 0) // ARITY], of_first if isinstance(of_first, int) else of_first[self.group])

    def replies(self, holders: bool, totals: np.ndarray, parents: np.ndarray) -> pa.Table:
        """Back to the order of each request. totals: of each distinct key; parents: of each sorted key."""
        all_ = np.empty(len(self.order), "i8")
        all_[self.order] = totals[self.group]
        told = np.empty(len(self.order), "i8")
        if holders:
            told[self.order] = parents
        ends = np.cumsum(self.sizes).tolist()
        out = [_told(holders, all_[e - n : e], told[e - n : e]) for e, n in zip(ends, self.sizes, strict=True)]
        return pa.table({"block": self.table.column("block"), "bucket": self.table.column("bucket"), "n": self.table.column("n"), "told": pa.array(out, pa.binary())})


def exchange(requests: DataFrame, plan: Plan, holders: bool) -> DataFrame:
    """The answers to all requests (see ``counted``)."""

    def answer(table: pa.Table) -> pa.Table:
        met = _Met(table)
        return met.replies(holders, met.sums, met.parents() if holders else met.sums)

    def merged(table: pa.Table) -> pa.Table:
        met = _Met(table.drop_columns(["cell"]))
        return _sent(plan, met.keys, met.sums, met.who()[met.starts] if holders else None, 1, table.column("cell")[0].as_py())

    def shared(table: pa.Table, replies: pa.Table) -> pa.Table:
        met = _Met(table.drop_columns(["cell"]))
        totals, parents = _hear(holders, replies)
        return met.replies(holders, totals, met.parents(parents) if holders else totals)

    if plan.span == 1:
        return requests.groupBy("bucket").applyInArrow(tidied(answer), _REPLIES)
    cells = requests.withColumn("cell", F.floor(F.col("block") / plan.fan) * plan.fan + F.col("bucket"))
    replies = cells.groupBy("cell").applyInArrow(tidied(merged), _REQUESTS).groupBy("bucket").applyInArrow(tidied(answer), _REPLIES)
    return cells.groupBy("cell").cogroup(replies.groupBy("block")).applyInArrow(tidied_pair(shared), _REPLIES)


def only(table: pa.Table, chosen: pa.Table) -> pa.Table:
    """The first row of each text whose digest ``h`` is chosen in this block."""
    left = set(chosen.column("c_h").to_pylist())
    mask = []
    for h in table.column("h").to_pylist():
        mask.append(h in left)
        left.discard(h)
    return table.filter(pa.array(mask, pa.bool_()))


def counted(blocked: DataFrame, plan: Plan, ask: Ask, finish: Finish, schema: str, chosen: DataFrame | None = None, holders: bool = False) -> DataFrame:
    """Rows of ``finish`` for each block.

    chosen: ``c_block`` and ``c_h``, block and digest ``h`` of the rows of ``blocked`` to go by; others are left out.

    ask: from a block's documents (in the order of ``sorted_block``) the sorted
    distinct 64-bit keys and the counts of each. finish: from the documents, the
    block's number and the totals over all blocks, in the order of the keys, a table
    of ``schema``.

    holders: finish gets, instead of the totals, for each key -2 where it occurs
    once in all blocks, else another block that holds it and that this block may
    ask about it, or -1 if the others ask (a tree over the holders of each key, in
    which at most ``ARITY`` ask the same; blocks come in the same order in all trees).
    """
    picky = chosen is not None

    def request_chosen(table: pa.Table, side: pa.Table) -> pa.Table:
        found = only(sorted_block(table), side) if table.num_rows else table
        return asked(found, table.column("block")[0].as_py()) if found.num_rows else _REQUEST.empty_table()

    def request(table: pa.Table) -> pa.Table:
        return asked(sorted_block(table), table.column("block")[0].as_py())

    def asked(found: pa.Table, block: int) -> pa.Table:
        keys, counts = ask(found)
        return _sent(plan, plan.cut(keys), counts, None, plan.span, block)

    def end(table: pa.Table, replies: pa.Table) -> pa.Table:
        if picky:
            sides = pc.is_valid(replies.column("c_h"))
            found, replies = only(sorted_block(table), replies.filter(sides)), replies.filter(pc.invert(sides))
        else:
            found = sorted_block(table)
        totals, parents = _hear(holders, replies)
        if holders:
            totals = np.where(totals >= 2, parents, -2)
        return finish(found, table.column("block")[0].as_py(), totals)

    if chosen is None:
        requests = blocked.groupBy("block").applyInArrow(tidied(request), _REQUESTS)
    else:
        requests = blocked.groupBy("block").cogroup(chosen.groupBy("c_block")).applyInArrow(tidied_pair(request_chosen), _REQUESTS)
    replies = exchange(requests, plan, holders)
    if chosen is not None:
        replies = replies.unionByName(chosen.select(F.col("c_block").alias("block"), "c_h"), allowMissingColumns=True)
    return blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tidied_pair(end), schema)
