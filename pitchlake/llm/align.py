"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text is encoded by tokenizer A (byte-level BPE, of a space and the text) and by
tokenizer B (pieces with byte fallback, which puts the space there itself). Byte
offsets where tokens of both end cut the tokens into groups; tokens whose bytes
overlap are linked. How often a pair of ids is linked is counted over the corpus.

*Reading.* Documents are read in runs of about ``RUN_BYTES``. Neither tokenizer
has a token across a single space between two visible characters (A's pattern
starts a word there, no piece of B has a space mark after another character), so a
text is cut at these spaces and each different stretch of a run is encoded and
aligned once; runs go to a written table, with what each asks the stripes.

*Counting.* Pairs are dealt by their B id into ``STRIPES`` stripes; a stripe's
counts are one dense matrix, its B ids by all A ids, of fixed size: requests, summed
up in each task before, are added to it as they stream in, and row maxima give the
best partners. A frequent pair is one entry for each task, never a hot row.

*Scoring.* A stripe's requests, split by run where they are many, meet its counts;
answers go back to the run, which sums them up for each document.

Edge cases: a text that is null or empty, or whose tokens do not spell the space
and the text (such as one with the space mark itself), has no tokens, zeros, and an
empty ``groups_sha256``; repeated rows count and are scored each; null ids stay;
other columns do not matter; an empty table gives no rows; a very long text is a
run of its own and is encoded in slices.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import coded, decoded, opened, packed, shut, unpacked
from .common import prepare, runs, texts, tidied_batches, tidied_pair

RUN_BYTES = 4 << 20
SLICE = 1 << 20
STRIPES = 256
#: Pairs that a task sums up before it passes them on.
HELD_PAIRS = 2 << 20
#: Bytes of requests that meet a stripe's counts in one group.
MET_BYTES = 24 << 20
#: A single space between two visible characters of Latin scripts; nothing of either tokenizer lies across it.
VISIBLE = re.compile(r"[!-~À-ɏ]")
CUT = re.compile(rf"(?<={VISIBLE.pattern}) (?={VISIBLE.pattern})")
#: Stretches that are encoded in one call.
TOGETHER = 64
SPACE = "▁"


def _byte_of() -> dict[str, int]:
    """Bytes behind the characters of byte-level entries: printable ones stand for themselves, others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    def __post_init__(self):
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes], "i8"), np.array([len(x) for x in self.b_bytes], "i8")
        #: Ids as they stand in groups: A's before another of its group and as its last, then B's.
        self._texts = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]

    def said(self, codes: np.ndarray) -> list[str]:
        texts = self._texts
        return [texts[c] for c in codes.tolist()]

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        a = tokenizers.Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = _byte_of()
        a_bytes = [b""] * (1 + max([a.get_vocab_size() - 1, *vocabulary.values()]))
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(byte[c] for c in token)
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if any(SPACE in b.id_to_piece(i).lstrip(SPACE) for i in range(b.get_piece_size())):
            raise ValueError("tokenizer B has pieces across spaces: texts cannot be cut there")
        b_bytes = []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(SPACE, " ").encode())
        return cls(a, b, a_bytes, b_bytes)


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _loaded(paths: tuple[str, str]) -> Tokenizers:
    """A worker's tokenizers, read once."""
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers.load(*paths)
    return _LOADED[paths]


@dataclass
class Stretches:
    """Different stretches of text, aligned. Links and pairs of ids stand in the order of their stretches."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    groups: list[str]
    n_groups: np.ndarray
    link_starts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @classmethod
    def of(cls, stretches: list[str], t: Tokenizers) -> Stretches:
        good, a, b = np.ones(len(stretches), bool), [], []
        for i, j, a_ids, b_ids, same in _encoded(stretches, t):
            good[i:j] = same
            if same:
                a += a_ids
                b += b_ids
        a, b = np.array(a, "i8"), np.array(b, "i8")
        stretch_ends = np.cumsum([len(s.encode()) + 1 if g else 0 for s, g in zip(stretches, good.tolist(), strict=True)], dtype="i8")
        a_ends, b_ends = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        a_last, b_last = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        said = t.said(np.concatenate([2 * a + a_last, 2 * (len(t.a_bytes) + b) + b_last])[order])
        until = np.searchsorted(both, stretch_ends, "right")  # groups up to the end of each stretch
        a_until, b_until = np.searchsorted(a_ends, stretch_ends, "right"), np.searchsorted(b_ends, stretch_ends, "right")
        text_ends = (a_until + b_until).tolist()
        groups = ["".join(said[i:j])[:-1] for i, j in zip([0, *text_ends], text_ends, strict=False)]
        cuts = np.union1d(a_ends, b_ends)  # a link for each range of bytes between two cuts
        starts = np.concatenate([[0], np.searchsorted(cuts, stretch_ends, "right")])
        return cls(good, np.diff(a_until, prepend=0), np.diff(b_until, prepend=0), groups, np.diff(until, prepend=0), starts, a[np.searchsorted(a_ends, cuts)], b[np.searchsorted(b_ends, cuts)])


def _encoded(stretches: list[str], t: Tokenizers) -> Iterator[tuple[int, int, list[int], list[int], bool]]:
    """Ranges of stretches in order, their ids, and whether both spell them; stretches that begin and end visibly are encoded several at once."""
    units, start = [], 0
    visible = [bool(VISIBLE.match(s[0]) and VISIBLE.match(s[-1])) for s in stretches]
    for i in range(1, len(stretches) + 1):
        if i == len(stretches) or i - start == TOGETHER or not visible[i] or not visible[i - 1]:
            units.append((start, i))
            start = i

    def encode(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[int], list[int], bool]]:
        joined = [" ".join(stretches[i:j]) for i, j in ranges]
        a = [e.ids for e in t.a.encode_batch_fast([" " + x for x in joined], add_special_tokens=False)]
        b = t.b.encode(joined, num_threads=1)
        spelt = lambda ids, pieces: b"".join([pieces[k] for k in ids])
        return [(i, j, x, y, spelt(x, t.a_bytes) == b" " + raw.encode() == spelt(y, t.b_bytes)) for (i, j), raw, x, y in zip(ranges, joined, a, b, strict=True)]

    for found in encode(units):
        i, j, _, _, same = found
        if same or j - i == 1:
            yield found
        else:
            yield from encode([(k, k + 1) for k in range(i, j)])


def sliced(text: str) -> Iterator[str]:
    """Parts of about ``SLICE`` characters, cut where stretches are."""
    at = 0
    while len(text) - at > SLICE and (m := CUT.search(text, at + SLICE)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def _spread(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges ``starts[i]:starts[i + 1]`` of the entries ``of``: all their places, and which entry each comes from."""
    sizes = (starts[1:] - starts[:-1])[of]
    total = int(sizes.sum())
    which = np.repeat(np.arange(len(of)), sizes)
    return np.arange(total) + np.repeat(starts[of] - (np.cumsum(sizes) - sizes), sizes), which


@dataclass
class Run:
    """A run of documents: how often each has each pair, and what the run asks."""

    docs: pa.Table
    bag: bytes
    asks: list[dict]


def read_run(ids: pa.Array, found: list[str], t: Tokenizers, width: int, stripes: int, keep: bool = False) -> Run:
    """ids: of documents, whose texts are ``found``; width: number of A ids."""
    number: dict[str, int] = {}
    places = [[np.array([number.setdefault(s, len(number)) for s in CUT.split(part)], "i4") for part in sliced(text)] if text else [] for text in found]
    s = Stretches.of(list(number), t)
    ok = [bool(p) and all(s.good[x].all() for x in p) for p in places]
    none, shas, kept = np.zeros(0, "i4"), [], []
    for p, fine in zip(places, ok, strict=True):
        sha, first, said = hashlib.sha256(), True, []
        for x in p if fine else ():
            told = ";".join([s.groups[i] for i in x.tolist()])
            sha.update((told if first else ";" + told).encode())
            first = False
            if keep:
                said.append(told)
        shas.append(sha.hexdigest() if fine else "")
        kept.append(";".join(said))
    flat = [np.concatenate([none, *p]) if fine else none for p, fine in zip(places, ok, strict=True)]
    doc = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    stretch = np.concatenate([none, *flat]).astype("i8")
    sums = lambda per: np.bincount(doc, per[stretch], len(flat)).astype("i8") if len(doc) else np.zeros(len(flat), "i8")
    table = {"doc_id": ids, "n_a": sums(s.n_a), "n_b": sums(s.n_b), "n_groups": sums(s.n_groups), "n_links": sums(np.diff(s.link_starts)), "groups_sha256": pa.array(shas, pa.string())}
    if keep:
        table["groups"] = pa.array(kept, pa.string())
    bag, times = np.unique(doc * max(1, len(number)) + stretch, return_counts=True)
    bag_doc, bag_stretch = bag // max(1, len(number)), bag % max(1, len(number))
    used, at = np.unique(bag_stretch, return_inverse=True)
    weight = np.bincount(at, times, len(used)).astype("i8") if len(used) else np.zeros(0, "i8")
    where, whose = _spread(s.link_starts, used)
    key = (s.link_b[where] % stripes) << 40 | (s.link_b[where] // stripes) * width + s.link_a[where]
    pairs, pair = np.unique(key, return_inverse=True)
    counts = np.bincount(pair, weight[whose], len(pairs)).astype("i8") if len(pairs) else np.zeros(0, "i8")
    edges = np.flatnonzero(np.diff(pairs >> 40, prepend=-1, append=-1)).tolist() if len(pairs) else [0]
    asks = [
        {"stripe": int(pairs[a] >> 40), "n": b - a, "keys": coded((pairs[a:b] & ((1 << 40) - 1)).astype("u8")), "counts": packed(counts[a:b])}
        for a, b in zip(edges, edges[1:], strict=False)
    ]
    per_stretch = np.bincount(whose, minlength=len(used)) if len(used) else np.zeros(0, "i8")
    stored = (np.bincount(bag_doc, minlength=len(flat)), at, times, per_stretch, pair)
    planes = (np.array([len(x)], "<i8").tobytes() + np.ascontiguousarray(x.astype("<i4").view("u1").reshape(-1, 4).T).tobytes() for x in stored)
    return Run(pa.table(table), shut(b"".join(planes)), asks)


def _sums(bag: bytes, n_docs: int, totals: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document the sum of the counts of its links, and how many of them are best. totals, best: of the run's pairs in order."""
    raw, parts, at = opened(bag), [], 0
    for _ in range(5):
        n = int(np.frombuffer(raw, "<i8", 1, at)[0])
        parts.append(np.ascontiguousarray(np.frombuffer(raw, "u1", 4 * n, at + 8).reshape(4, n).T).view("<i4").ravel().astype("i8"))
        at += 8 + 4 * n
    per_doc, stretch, times, per_stretch, pair = parts
    ends = np.cumsum(per_stretch)
    doc = np.repeat(np.arange(n_docs), per_doc)

    def summed(of_pair: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(of_pair[pair])])
        of_stretch = running[ends] - running[ends - per_stretch]
        out = np.zeros(n_docs, "i8")
        np.add.at(out, doc, of_stretch[stretch] * times)
        return out

    return summed(totals), summed(best.astype("i8"))


_ASKS = "array<struct<stripe:int, n:int, keys:binary, counts:binary>>"
_ASK = pa.list_(pa.struct([("stripe", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


@dataclass
class Alignment:
    """A written table of runs, and the counts of pairs by stripe and B id."""

    table: DataFrame
    counts: DataFrame
    width: int
    stripes: int
    id_type: str
    keep: bool

    def pairs(self) -> DataFrame:
        """``b_id``, ``a_id``, ``n`` (links between them), ``best`` (no other A id has more for this B id)."""
        stripes, width = self.stripes, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for stripe, n, raw, told, top in zip(*(batch.column(c).to_pylist() for c in ("stripe", "n", "keys", "totals", "top")), strict=True):
                    keys, totals = decoded(raw, n).astype("i8"), unpacked(told, n)
                    yield pa.RecordBatch.from_arrays([pa.array(keys // width * stripes + stripe), pa.array(keys % width), pa.array(totals), pa.array(totals == top)], names=["b_id", "a_id", "n", "best"])

        return self.counts.mapInArrow(run, "b_id long, a_id long, n long, best boolean")

    def documents(self) -> DataFrame:
        """A row for each document: ``doc_id``, counts, ``n_best``, ``count_sum``, ``groups_sha256`` (and ``groups`` if kept)."""
        asked = self.table.select("run", F.explode("asks").alias("ask")).select("run", "ask.stripe", "ask.n", "ask.keys")
        size = asked.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0]
        salts = max(1, -(-size // (self.stripes * MET_BYTES)))
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(salts)))
        told = self.counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        replies = salted.groupBy("stripe", "salt").cogroup(told.groupBy("stripe", "salt")).applyInArrow(tidied_pair(_answers), "run long, stripe int, n int, totals binary, best binary")
        schema = f"doc_id {self.id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * self.keep
        names = [x.split()[0] for x in schema.split(", ")]

        def end(own: pa.Table, replies: pa.Table) -> pa.Table:
            rows = sorted(zip(*(replies.column(c).to_pylist() for c in ("stripe", "n", "totals", "best")), strict=True))
            totals = np.concatenate([np.zeros(0, "i8"), *(unpacked(x, n) for _, n, x, _ in rows)])
            best = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x, "u1"), count=n).astype(bool) for _, n, _, x in rows)])
            docs = pa.ipc.open_stream(own.column("docs")[0].as_py()).read_all()
            count_sum, n_best = _sums(own.column("bag")[0].as_py(), docs.num_rows, totals, best)
            return docs.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).select(names)

        return self.table.select("run", "docs", "bag").groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(tidied_pair(end), schema)


def _answers(asked: pa.Table, told: pa.Table) -> pa.Table:
    """Totals and marks of best partners for the keys of each request; told: the stripe's counts, a row for each B id."""
    rows = sorted(zip(*(told.column(c).to_pylist() for c in ("row", "n", "keys", "totals", "top")), strict=True))
    keys = np.concatenate([np.zeros(0, "u8"), *(decoded(k, n) for _, n, k, _, _ in rows)])
    totals = np.concatenate([np.zeros(0, "i8"), *(unpacked(x, n) for _, n, _, x, _ in rows)])
    best = totals == np.repeat([r[4] for r in rows], [r[1] for r in rows]) if rows else totals > 0
    out_totals, out_best = [], []
    for raw, n in zip(asked.column("keys").to_pylist(), asked.column("n").to_pylist(), strict=True):
        at = np.searchsorted(keys, decoded(raw, n))
        out_totals.append(packed(totals[at]))
        out_best.append(np.packbits(best[at]).tobytes())
    return pa.table({"run": asked.column("run"), "stripe": asked.column("stripe"), "n": asked.column("n"), "totals": pa.array(out_totals, pa.binary()), "best": pa.array(out_best, pa.binary())})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, run_bytes: int = RUN_BYTES, keep: bool = False) -> Alignment:
    """Read, count; see ``Alignment`` for what can be asked then. keep: keep each document's groups as text."""
    spark = prepare(docs.sparkSession)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/align-{uuid.uuid4().hex}"
    with open(a_path, encoding="utf-8") as f:
        width = 1 + max(json.load(f)["model"]["vocab"].values())
    own = texts(docs, id_col, text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, number = _loaded((a_path, b_path)), TaskContext.get().partitionId(), 0
        for table in _gathered(batches, run_bytes):
            run = read_run(table.column("doc_id").combine_chunks(), table.column("text").to_pylist(), t, width, stripes, keep)
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([_ipc(run.docs)], pa.binary()), pa.array([run.bag], pa.binary()), pa.array([run.asks], _ASK)], names=["run", "docs", "bag", "asks"])
            number += 1

    own.mapInArrow(tidied_batches(read), f"run long, docs binary, bag binary, asks {_ASKS}").write.parquet(f"{folder}/runs")
    table = spark.read.parquet(f"{folder}/runs")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        pending = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.zeros(len(keys), "i8")
            np.add.at(counts, at, np.concatenate([c for _, c in parts]))
            return keys, counts

        def flush() -> pa.RecordBatch:
            rows = [(s, *merged(parts)) for s, parts in sorted(held.items())]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), pa.array([len(k) for _, k, _ in rows], pa.int32()), pa.array([coded(k) for _, k, _ in rows], pa.binary()), pa.array([packed(c) for _, _, c in rows], pa.binary())], names=["stripe", "n", "keys", "counts"])

        for batch in batches:
            for stripe, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "n", "keys", "counts")), strict=True):
                held.setdefault(stripe, []).append((decoded(keys, n), unpacked(counts, n)))
                pending += n
            if pending >= HELD_PAIRS:
                held = {s: [merged(parts)] for s, parts in held.items()}
                pending = sum(len(parts[0][0]) for parts in held.values())
                if pending >= HELD_PAIRS // 2:
                    yield flush()
                    held, pending = {}, 0
        if held:
            yield flush()

    rows = -(-max(1, _vocabulary_size(b_path)) // stripes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, stripe = np.zeros(rows * width, "i8"), None
        for batch in batches:
            for s, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "n", "keys", "counts")), strict=True):
                stripe = s
                np.add.at(matrix, decoded(keys, n).astype("i8"), unpacked(counts, n))
        top = matrix.reshape(rows, width).max(axis=1)
        for row in np.flatnonzero(top).tolist():
            at = row * width + np.flatnonzero(matrix[row * width : (row + 1) * width])
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([row], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([coded(at.astype("u8"))], pa.binary()), pa.array([packed(matrix[at])], pa.binary()), pa.array([top[row]])], names=["stripe", "row", "n", "keys", "totals", "top"])

    asked = table.select(F.explode("asks").alias("ask")).select("ask.*")
    sums = asked.mapInArrow(tidied_batches(summed), "stripe int, n int, keys binary, counts binary")
    sums.groupBy("stripe").applyInArrow(_streamed(counted), "stripe int, row int, n int, keys binary, totals binary, top long").write.parquet(f"{folder}/counts")
    return Alignment(table, spark.read.parquet(f"{folder}/counts"), width, stripes, dict(docs.select(id_col).dtypes)[id_col], keep)


def _vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def _streamed(f):
    """With the types that tell Spark to pass a group's batches one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes of text; a longer text stands alone."""
    waiting, size = [], 0
    for batch in batches:
        for part in runs(batch, "text", most):
            if waiting and size + part.nbytes > most:
                yield pa.Table.from_batches(waiting)
                waiting, size = [], 0
            waiting.append(part)
            size += part.nbytes
    if waiting:
        yield pa.Table.from_batches(waiting)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of both public vocabularies align in every text of ``documents``."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).documents()
