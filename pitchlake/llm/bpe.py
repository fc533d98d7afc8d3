"""Byte-level BPE by DuckDB recursive queries, one small database per Python worker.

Encoding: a text falls into pretokens (``pattern``). A distinct pretoken that is
no token itself is a piece; one of more than ``SHORT`` bytes is cut into pieces
where no token of the vocabulary can lie across (exact: a contraction never makes
bytes meet that stand together in no token). Pieces become token-position rows. A recursive query joins neighbouring rows with
the merge table, contracts each piece's leftmost pair of minimum rank and repeats
until no piece has a pair left. Decoding joins the ids with the vocabulary and
gathers their bytes by ordered aggregation.

Two recursive queries do the same. For pieces of up to ``SHORT`` bytes every
step's rows are kept and the last step's read, which is fast, and takes memory by
the square of a length; the sum of squares in one query is bounded. For longer
pieces the recursion is keyed by position, so that only the newest rows stay,
and a step contracts all places of the least pair, where the new token takes part
in no pair of lower rank (then no contraction can come between them).

Work is per input partition: nothing is shuffled. A worker keeps the encodings
of the words it met last, in two generations of up to ``CACHE_WORDS`` distinct
words (and those of one run of texts); the bound changes speed only.

Edge cases: null text counts as empty (no ids, empty bytes); empty tables give
empty results; repeated rows are encoded each; a long pretoken takes memory by
its length and time by its length times the number of different contractions.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, runs, texts

CACHE_WORDS = 500_000
#: Bytes of the longest piece whose steps are all kept, and the sum of squared lengths in one such query.
SHORT = 48
CHUNK_SQUARES = 2_000_000
#: Bytes of longer pieces in one query (a single longer piece stands alone).
CHUNK_BYTES = 400_000
#: Bytes of text (of ids, when decoding) handled at a time.
RUN_BYTES = 1_500_000

_POSITION_BITS = 24

_ENCODE = f"""
WITH RECURSIVE state(step, word, pos, nxt, id) AS (
    SELECT 0, word, pos, pos + 1, id FROM symbols
    UNION ALL
    (WITH pairs AS (
        SELECT l.word, l.pos, r.pos AS gone, r.nxt AS follows, (m.merged::BIGINT << {_POSITION_BITS}) + l.pos AS best
        FROM state l
        JOIN state r ON r.word = l.word AND r.pos = l.nxt
        JOIN merges m ON m.a = l.id AND m.b = r.id),
     chosen AS (
        SELECT word, min(best) AS best, arg_min(pos, best) AS spot, arg_min(gone, best) AS gone, arg_min(follows, best) AS follows
        FROM pairs GROUP BY word)
     SELECT s.step + 1, s.word, s.pos,
            CASE WHEN s.pos = c.spot THEN c.follows ELSE s.nxt END,
            CASE WHEN s.pos = c.spot THEN (c.best >> {_POSITION_BITS})::INT ELSE s.id END
     FROM state s JOIN chosen c ON c.word = s.word AND s.pos <> c.gone))
SELECT word, list(id ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) GROUP BY word ORDER BY word
"""

_ENCODE_LONG = """
WITH RECURSIVE state(word, pos, nxt, id) USING KEY (word, pos) AS (
    SELECT word, pos, pos + 1, id FROM symbols
    UNION
    (WITH live AS (SELECT s.* FROM recurring.state s SEMI JOIN state t ON t.word = s.word WHERE s.id >= 0),
     pairs AS (
        SELECT l.word, l.pos, r.pos AS gone, r.nxt AS follows, m.merged, m.alone, min(m.merged) OVER (PARTITION BY l.word) AS best
        FROM live l
        JOIN live r ON r.word = l.word AND r.pos = l.nxt
        JOIN merges m ON m.a = l.id AND m.b = r.id),
     least AS (
        SELECT *, row_number() OVER places AS k, lag(gone) OVER places IS NOT DISTINCT FROM pos AS chained
        FROM pairs WHERE merged = best WINDOW places AS (PARTITION BY word ORDER BY pos)),
     runs AS (SELECT *, max(CASE WHEN chained THEN 0 ELSE k END) OVER (PARTITION BY word ORDER BY k) AS head FROM least),
     chosen AS (SELECT * FROM runs WHERE CASE WHEN alone THEN k = 1 ELSE (k - head) % 2 = 0 END)
     SELECT word, pos, follows, merged FROM chosen
     UNION ALL
     SELECT word, gone, -1, -1 FROM chosen))
SELECT word, list(id ORDER BY pos) AS ids FROM state WHERE id >= 0 GROUP BY word ORDER BY word
"""

_DECODE = """
SELECT doc, list(v.bytes ORDER BY pos) AS parts
FROM tokens JOIN vocabulary v USING (id) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> bytes:
    """The ranks file as it is: lines of base64 token and rank. Its size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.byte_ids = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], "i4")
        pairs = np.array([(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks], "i4").reshape(-1, 3)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "merged": pairs[:, 2]})
        vocabulary = pa.table({"id": np.array(list(self.ranks.values()), "i4"), "bytes": pa.array(list(self.ranks), pa.binary())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("arriving", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM arriving")
            self.con.unregister("arriving")
        # a token that takes part in a pair of lower rank than its own is contracted alone, place by place
        self.con.execute("ALTER TABLE merges ADD COLUMN alone BOOLEAN")
        self.con.execute("UPDATE merges SET alone = merged IN (SELECT a FROM merges WHERE merged < a UNION SELECT b FROM merges WHERE merged < b)")
        # pairs of bytes that are a token, and runs of three bytes that a token holds
        self.pairs, self.threes = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for t in self.ranks:
            x = np.frombuffer(t, "u1").astype("i4")
            if len(x) == 2:
                self.pairs[x[0] << 8 | x[1]] = True
            elif len(x) > 2:
                self.threes[x[:-2] << 16 | x[1:-1] << 8 | x[2:]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ask(self, name: str, table: pa.Table, query: str) -> pa.Table:
        self.con.register(name, table)
        out = self.con.sql(query).to_arrow_table()
        self.con.unregister(name)
        return out

    def _contract(self, pieces: list[bytes], query: str) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each piece."""
        lengths = np.array([len(w) for w in pieces])
        word = np.repeat(np.arange(len(pieces), dtype="i4"), lengths)
        starts = np.cumsum(lengths) - lengths
        symbols = pa.table({"word": word, "pos": (np.arange(len(word)) - starts[word]).astype("i4"), "id": self.byte_ids[np.frombuffer(b"".join(pieces), "u1")]})
        ids = self._ask("symbols", symbols, query)["ids"].combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() - ids.offsets[0].as_py()) * 4
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _cut(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word in pieces that no token connects: a token across a place is its two bytes, or holds three about it."""
        raw = b"".join(words)
        x = np.frombuffer(raw, "u1").astype("i4")
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        last = np.zeros(len(x), bool)
        last[ends - 1] = True
        three = self.threes[x[:-2] << 16 | x[1:-1] << 8 | x[2:]] & ~last[:-2] & ~last[1:-1]
        across = np.zeros(len(x), bool)
        across[:-1] = self.pairs[x[:-1] << 8 | x[1:]]
        across[:-2] |= three
        across[1:-1] |= three
        stops = np.flatnonzero(~across | last) + 1
        pieces = [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        at = [0, *np.searchsorted(stops, ends, side="right").tolist()]
        return [pieces[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _contracted(self, pieces: list[bytes], weigh: Callable[[bytes], int], most: int, query: str) -> Iterator[list[bytes]]:
        """Ids of each piece, some pieces of a bounded weight at a time."""
        first, size = 0, 0
        for i, p in enumerate(pieces):
            w = weigh(p)
            if i > first and size + w > most:
                yield self._contract(pieces[first:i], query)
                first, size = i, 0
            size += w
        if first < len(pieces):
            yield self._contract(pieces[first:], query)

    def _learn(self, words: list[str]) -> None:
        ranks = self.ranks
        raw = [w.encode() for w in words]
        whole = [i for i, r in enumerate(raw) if r in ranks]
        short = [i for i, r in enumerate(raw) if len(r) <= SHORT and r not in ranks]
        long = [i for i, r in enumerate(raw) if len(r) > SHORT and r not in ranks]
        self.known.update(zip([words[i] for i in whole], np.array([ranks[raw[i]] for i in whole], "<u4").view("V4").tolist(), strict=True))
        square = lambda p: len(p) ** 2
        ids = itertools.chain.from_iterable(self._contracted([raw[i] for i in short], square, CHUNK_SQUARES, _ENCODE))
        self.known.update(zip([words[i] for i in short], ids, strict=True))
        if long:
            cut = self._cut([raw[i] for i in long])
            wanted = {p for pieces in cut for p in pieces}
            found = {p: np.array([ranks[p]], "<u4").tobytes() for p in wanted & ranks.keys()}
            wanted.difference_update(found)
            for pieces, weigh, most, query in (([p for p in wanted if len(p) <= SHORT], square, CHUNK_SQUARES, _ENCODE), ([p for p in wanted if len(p) > SHORT], len, CHUNK_BYTES, _ENCODE_LONG)):
                found.update(zip(pieces, itertools.chain.from_iterable(self._contracted(pieces, weigh, most, query)), strict=True))
            self.known.update((words[i], b"".join([found[p] for p in pieces])) for i, pieces in zip(long, cut, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.split(x) for x in texts]
        wanted = set().union(*split)
        if len(self.known) + len(wanted) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        wanted.difference_update(known)
        known.update((w, older.pop(w)) for w in wanted & older.keys())
        self._learn([w for w in wanted if w not in known])
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for; an id outside the vocabulary raises."""
        lengths = np.array([len(x) // 4 for x in ids], "i8")
        flat = np.frombuffer(b"".join(ids), "<u4").astype("i4")
        doc = np.repeat(np.arange(len(ids), dtype="i4"), lengths)
        starts = np.cumsum(lengths) - lengths
        tokens = pa.table({"doc": doc, "pos": (np.arange(len(flat)) - starts[doc]).astype("i4"), "id": flat})
        out = self._ask("tokens", tokens, _DECODE)
        found = [b""] * len(ids)
        for chunk in out.to_batches():
            parts = chunk.column("parts")
            values, ends = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
            if len(values):
                joined = memoryview(values.buffers()[2])
                at = np.frombuffer(values.buffers()[1], "i4" if values.type == pa.binary() else "i8")[values.offset : values.offset + len(values) + 1]
                for d, a, b in zip(chunk.column("doc").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    found[d] = bytes(joined[at[a] : at[b]])
                    lengths[d] -= b - a
        if lengths.any():
            raise ValueError("an id is not in the vocabulary")
        return found


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(ranks_file: bytes, pattern: str) -> Codec:
    """One codec a worker and vocabulary."""
    key = (hashlib.md5(ranks_file).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary: little-endian unsigned 32-bit) of every whole text."""
    spark = prepare(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for part in runs(batch, "text", RUN_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codec.encode(part.column("text").to_pylist()), pa.binary())], names=["doc_id", "ids"])

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` (binary) of rows with ``ids`` as ``encode`` gives them (null: empty)."""
    spark = prepare(encoded.sparkSession)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for part in runs(batch, "ids", RUN_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(codec.decode(part.column("ids").to_pylist()), pa.binary())], names=["doc_id", "ids", "decoded"])

    source = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def op1(spark, sf_dir: str) -> DataFrame:
    """Encode every text of ``documents``, decode the ids again, return digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
