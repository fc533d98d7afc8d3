"""Personal data by fixed patterns and by bootstrapped contexts.

The fixed patterns find e-mail addresses, IPv4 addresses, card and phone
numbers. They are the seeds: a lexical pattern is the words around one (the two
words before; the word before and the word after), with what is glued to it in
its own word. Digits in context words count as 0.

A first pass over the texts gathers seeds; patterns that at least
``LEAST_SEEDS`` different seed values support are open. A second pass finds every
whole token that fills the slot of an open pattern, whatever it is made of. Seeds
and such tokens form a graph of distinct (pattern, value) edges. Round by round, a
pattern's confidence is the mean score of its values (shrunk by ``SHRINK`` values
of score 0), and an unseen value's score is the chance that not all of its
patterns are wrong. Tokens in a pattern of confidence ``LEAST_CONFIDENCE`` are
further spans, of kind ``context``.

Patterns are numbers made from the hashes of their words, so a pass computes those
of all slots of some megabytes of texts at once. Frequent words stand in many open
patterns, and their tokens grow much faster than the input until all are caught;
so a token is never a row. The second pass sends each pair of a pattern and a value
that its task sees once, packed, to ranges of values; a range drops what other tasks
sent too and keeps the rest packed. A round reads the ranges where they are, with the
confidences of the round before, and sends one sum for each pattern. A third
pass finds the tokens in the patterns that passed.

All this holds the open patterns' numbers in a sorted list, 16 bytes each. Beyond
``MOST_OPEN`` the mentions are rows: their pass knows the open patterns by two bit
fields, which let too many tokens through, never too few, and joins by the numbers
do the rest, with the same results.

Edge cases: null and empty texts have no spans; without seeds there are no
patterns; repeated rows each keep their spans; positions are code points, end
exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Words, coded, decoded, opened, shut
from .common import blocks_for, prepare, runs, texts, tidied, tidied_batches, total_bytes

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 3
SHRINK = 1.0
LEAST_CONFIDENCE = 0.6
LEAST_SEEDS = 3
#: Bits for each number of the fields that tell the second pass which patterns, and which words before a slot, are open,
#: and the largest field, as a power of two: 32 MB.
NUMBER_BITS = 16
MOST_BITS = 28
#: Bits of a field that a task puts together, as a power of two.
CHUNK_BITS = 19
#: Bytes of texts whose words are looked up at a time.
RUN_BYTES = 2 << 20
#: The most open patterns that a list in each task holds.
MOST_OPEN = 1 << 20
#: Bytes of texts whose patterns are looked up at a time; of those whose edges meet in a range of values, about.
GATHERED_BYTES, RANGE_BYTES = 4 << 20, 32 << 20
#: Edges that a task holds before it sends them.
MOST_EDGES = 1 << 21

# The base patterns. A run of digits is entered at its start only, which finds the same matches in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A token of a word: no mark that encloses or separates; a full stop or dash at its end is none of it.
_TOKEN = re.compile(r"""[^\x20\x09-\x0D,;:=!?"'()<>\[\]{}|]+""")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ back over the local part, on over the domain."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
            at = text.find("@", low)
        else:
            # what lies before this @ may still be no part of a later match: the local part has no @
            low = at + 1
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = "".join(c for c in m[0] if c not in " -")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


#: Stand for the words before a text's first and after its last.
_FIRST, _LAST = " ^", " $"


def _number(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _folded(text: str) -> str:
    return _DIGITS.sub("0", text.lower())


_64 = (1 << 64) - 1


def _mixed(a, b):
    """A hash of pairs of hashes: of numbers, or of arrays of them."""
    x = (a * 0x9E3779B97F4A7C15 + b) & _64
    x = x ^ (x >> 29)
    x = (x * 0xD6E8FEB86659FD93) & _64
    return x ^ (x >> 32)


def _pair(earlier, before, left, right, after):
    """Numbers of the two patterns of a slot: from the hashes of the two words before, of what is glued to it on either side, of the word after."""
    near = _mixed(before, left)
    return _mixed(earlier, near), _mixed(_mixed(near, right), after)


class Context:
    """A text's words, and the patterns around spans of it."""

    def __init__(self, text: str):
        self.text = text
        self.places = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.places]

    def word(self, i: int) -> str:
        """The i-th word as patterns see it; a mark stands before the first and after the last."""
        if i < 0:
            return _FIRST
        return _folded(self.text[slice(*self.places[i])]) if i < len(self.places) else _LAST

    def patterns(self, start: int, end: int) -> tuple[int, int, int]:
        """Numbers of the word before a span's word, and of its two patterns."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        left, right = _folded(self.text[self.places[i][0] : start]), _folded(self.text[end : self.places[j][1]])
        one = _number(self.word(i - 1))
        return one, *_pair(_number(self.word(i - 2)), one, _number(left), _number(right), _number(self.word(j + 1)))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def seeds(docs: DataFrame) -> DataFrame:
    """``pattern``, ``before`` (its word before) and ``value``, as numbers, of every seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for text in batch.column("text").to_pylist():
                if base := base_spans(text):
                    context = Context(text)
                    for _, a, b in base:
                        one, *patterns = context.patterns(a, b)
                        rows += [(p, one, _number(text[a:b].lower())) for p in patterns]
            flat = np.array(rows, "u8").reshape(-1, 3).view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["pattern", "before", "value"])

    return texts(docs).select("text").mapInArrow(tidied_batches(run), "pattern long, before long, value long")


#: Odd factors whose products' leading bits are a number's places in a field.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class Field:
    """A Bloom filter of 64-bit numbers: at 16 bits a number fewer than 3 in 1,000 others seem to be in it."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def __contains__(self, number: int) -> bool:
        for f in _FACTORS:
            at = (number * f & _64) >> (64 - self.bits)
            if not int(self.words[at >> 6]) >> (at & 63) & 1:
                return False
        return True

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        """For each number whether it seems to be in the field."""
        out = np.ones(len(numbers), bool)
        for at in places(numbers, self.bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def places(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(numbers.astype("u8") * np.uint64(f)) >> np.uint64(64 - bits) for f in _FACTORS]


def field(numbers: DataFrame, column: str) -> Field:
    """The field of ``column``, sized by how many numbers there are; the driver gets it in chunks of 64 KB, 32 MB at most.

    Beyond 16 million numbers it lets more others through. That costs volume only:
    what passes is joined with the open patterns themselves afterwards.
    """
    numbers = numbers.select(column).distinct()
    bits = min(MOST_BITS, max(12, (NUMBER_BITS * numbers.count()).bit_length()))
    chunk = min(bits, CHUNK_BITS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(places(batch.column(0).to_numpy(zero_copy_only=False).view("u8"), bits)).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array((at >> chunk).astype("i4")), pa.array((at & ((1 << chunk) - 1)).astype("i4"))], names=["chunk", "at"])

    def packed(group: pa.Table) -> pa.Table:
        out = np.zeros(1 << chunk, bool)
        out[group.column("at").to_numpy()] = True
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "bytes": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    words = np.zeros(1 << (bits - 6), "u8")
    size = 1 << (chunk - 6)
    for r in numbers.mapInArrow(spread, "chunk int, at int").groupBy("chunk").applyInArrow(packed, "chunk int, bytes binary").collect():
        words[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["bytes"], "<u8")
    return Field(bits, words)


def mentions(text: str, base: list[tuple[int, int, int]], slots: list[int], patterns: Field) -> list[tuple]:
    """Seeds and tokens in open patterns: start, end, is a seed, value, patterns. slots: words behind an open word."""
    if not base and not slots:
        return []
    context = Context(text)
    found = [(a, b, True) for _, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    ends = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    starts = [a for a, _ in taken]
    for i in slots:
        for m in _TOKEN.finditer(text, *context.places[i]):
            a, b = m.start(), m.start() + len(m[0].rstrip(".-"))
            k = bisect_right(starts, b - 1)
            if a < b and (k == 0 or ends[k - 1] <= a):
                found.append((a, b, False))
    out = []
    for a, b, seed in found:
        open_ = [_signed(p) for p in context.patterns(a, b)[1:] if p in patterns]
        if open_:
            out.append((a, b, seed, _signed(_number(text[a:b].lower())), open_))
    return out


def _slots(raw: list[str], words: Field) -> list[list[int]]:
    """For each text the words that follow an open one (or its start)."""
    folded = [_folded(t).encode("utf-8", "surrogatepass") for t in raw]
    if not words.words.any():
        return [[] for _ in raw]
    own = Words.of(folded)
    opened = words.holds(own.hashes)  # the same hash as _number's
    hit = np.flatnonzero(opened[own.ids]) if len(own.ids) else np.zeros(0, "i8")
    doc = np.searchsorted(own.starts, hit, side="right") - 1
    place = hit - own.starts[doc] + 1
    inside = place < own.lengths[doc]
    start = _number(_FIRST) in words
    out: list[list[int]] = [[0] if n and start else [] for n in own.lengths.tolist()]
    for d, i in zip(doc[inside].tolist(), place[inside].tolist(), strict=True):
        out[d].append(i)
    return out


def extract(docs: DataFrame, patterns: Field, words: Field) -> DataFrame:
    """``row, doc_id, base, mentions`` of every text, checkpointed so that ``row`` stays. patterns, words: fields of the open ones."""
    shared = docs.sparkSession.sparkContext.broadcast((patterns, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, words = shared.value
        for whole in batches:
            for batch in runs(whole, "text", RUN_BYTES):
                base, found = [], []
                raw = batch.column("text").to_pylist()
                for text, slots in zip(raw, _slots(raw, words), strict=True):
                    spans = base_spans(text)
                    base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                    found.append([dict(zip(("start", "end", "seed", "value", "patterns"), m, strict=True)) for m in mentions(text, spans, slots, patterns)])
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_MENTION))], names=["row", "doc_id", "base", "mentions"])

    source = texts(docs).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, base array<struct<kind:int,start:bigint,end:bigint>>, mentions array<struct<start:bigint,end:bigint,seed:boolean,value:bigint,patterns:array<bigint>>>"
    return source.mapInArrow(tidied_batches(run), schema).checkpoint()


def bootstrap(found: DataFrame, opened: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern`` and ``confidence`` of the ``opened`` patterns that pass, from the mentions of ``extract``."""
    each = found.select(F.explode("mentions").alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.value", "m.seed")
    edges = each.groupBy("pattern", "value").agg(F.max("seed").alias("seed")).join(opened, "pattern", "left_semi").checkpoint()
    # a value that is a seed anywhere is one everywhere
    values = edges.groupBy("value").agg(F.max("seed").alias("known")).withColumn("score", F.col("known").cast("double")).checkpoint()
    for i in range(rounds):
        scored = edges.select("pattern", "value").join(values, "value")
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + SHRINK)).alias("confidence"))
        if i < rounds - 1:
            doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence"))))
            by_value = edges.select("pattern", "value").join(patterns, "pattern").groupBy("value").agg((1 - F.exp(doubt)).alias("new"))
            values = values.join(by_value, "value", "left").select("value", "known", F.when(F.col("known"), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("score")).checkpoint()
    return patterns.where(F.col("confidence") >= LEAST_CONFIDENCE).select("pattern", "confidence")


class Slots:
    """Sorted open patterns, and which tokens of texts stand in their slots."""

    def __init__(self, patterns: np.ndarray, before: np.ndarray):
        order = np.argsort(patterns)
        self.patterns, self.before = patterns[order], before[order]

    def __len__(self) -> int:
        return len(self.patterns)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Where each number stands in the list; -1: nowhere."""
        if not len(self):
            return np.full(len(numbers), -1)
        at = np.minimum(np.searchsorted(self.patterns, numbers), len(self) - 1)
        return np.where(self.patterns[at] == numbers, at, -1)

    def tokens(self, raw: list[bytes], base: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, ...]:
        """Tokens in slots, none of which overlaps ``base``: text, start, end, value, and the two patterns' places, by text and start."""
        words = Words.of(raw)
        ids, starts = words.ids, words.starts[words.lengths > 0]
        vocabulary = [w.decode("utf-8", "surrogatepass") for w in words.vocabulary]
        hashes = np.array([_number(_folded(w)) for w in vocabulary], "u8")
        opens = np.isin(hashes, self.before)
        first, last = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        first[starts], last[np.append(starts[1:], len(ids))[: len(starts)] - 1] = True, True
        slot = np.zeros(len(ids), bool)
        slot[1:] = opens[ids[:-1]]
        slot[starts] = bool(np.isin(np.uint64(_number(_FIRST)), self.before))
        slot = np.flatnonzero(slot)
        # the tokens of each different word in a slot: where, what is glued to them, their value
        at, counts, rows = np.zeros(len(vocabulary), "i8"), np.zeros(len(vocabulary), "i8"), []
        nothing = _number("")
        for i in np.unique(ids[slot]).tolist():
            w, at[i] = vocabulary[i], len(rows)
            if w.isalnum():
                rows.append((0, len(w), nothing, nothing, _number(w.lower())))
            else:
                for m in _TOKEN.finditer(w):
                    a, b = m.start(), m.start() + len(m[0].rstrip(".-"))
                    if a < b:
                        rows.append((a, b, _number(_folded(w[:a])), _number(_folded(w[b:])), _number(w[a:b].lower())))
            counts[i] = len(rows) - at[i]
        table = np.array(rows, "u8").reshape(-1, 5)
        times = counts[ids[slot]]
        token = np.repeat(at[ids[slot]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        slot = np.repeat(slot, times)
        initial, final = np.uint64(_number(_FIRST)), np.uint64(_number(_LAST))
        one = np.where(first[slot], initial, hashes[ids[slot - 1]])
        two = np.where(first[slot] | first[slot - 1], initial, hashes[ids[slot - 2]])
        next_ = np.where(last[slot], final, hashes[ids[np.minimum(slot + 1, len(ids) - 1)]])
        numbers = _pair(two, one, table[token, 2], table[token, 3], next_)
        which = np.stack([self.places(n) for n in numbers], 1)
        hit = (which >= 0).any(1)
        slot, token, which = slot[hit], token[hit], which[hit]
        # code points, counted through all texts
        whole = np.frombuffer(b"\n".join([*raw, b""]), "u1")
        white = (whole == 32) | ((whole >= 9) & (whole <= 13))
        begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        points = np.cumsum((whole & 0xC0) != 0x80, dtype="i4") - 1
        sizes = np.array([len(t) + 1 for t in raw], "i8")
        origin = points[np.cumsum(sizes) - sizes].astype("i8")
        text = np.searchsorted(starts, slot, side="right") - 1
        text = np.flatnonzero(words.lengths > 0)[text]
        start = points[begins[slot]] + table[token, 0].astype("i8")
        end = points[begins[slot]] + table[token, 1].astype("i8")
        if taken := sorted((origin[i] + a, origin[i] + b) for i, spans in enumerate(base) for _, a, b in spans):
            taken = np.array(taken)
            k = np.searchsorted(taken[:, 0], end - 1, side="right")
            free = (k == 0) | (np.maximum.accumulate(taken[:, 1])[k - 1] <= start)
            text, start, end, token, which = text[free], start[free], end[free], token[free], which[free]
        return text, start - origin[text], end - origin[text], table[token, 4], which


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``GATHERED_BYTES``."""
    waiting, size = [], 0
    for whole in batches:
        for batch in runs(whole, "text", GATHERED_BYTES):
            if waiting and size + batch.nbytes > GATHERED_BYTES:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, size = [], 0
            if batch.num_rows:
                waiting.append(batch)
                size += batch.nbytes
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _read(batch: pa.RecordBatch) -> tuple[list[str], list[bytes], list[list[tuple[int, int, int]]]]:
    raw = batch.column("text").to_pylist()
    return raw, [t.as_buffer().to_pybytes() for t in batch.column("text")], [base_spans(t) for t in raw]


def _sorted_edges(values: np.ndarray, patterns: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different edges by value and pattern; an edge is a seed's if one of its likes is."""
    order = np.lexsort((patterns, values))
    values, patterns, seed = values[order], patterns[order], seed[order]
    fresh = np.flatnonzero((np.diff(values, prepend=values[:1] ^ np.uint64(1)) != 0) | (np.diff(patterns, prepend=-1) != 0))
    return values[fresh], patterns[fresh], np.logical_or.reduceat(seed, fresh) if len(fresh) else seed


_EDGES = "range int, n_values int, n int, values binary, edges binary, known binary"
_PACKED = pa.schema([("range", pa.int32()), ("n_values", pa.int32()), ("n", pa.int32()), ("values", pa.binary()), ("edges", pa.binary()), ("known", pa.binary())])


def _packed_edges(values: np.ndarray, patterns: np.ndarray, seed: np.ndarray, n_patterns: int, n_ranges: int) -> pa.Table:
    """A row for each range of values: the values, their places times ``n_patterns`` plus the patterns', and which values are seeds."""
    of = ((values >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype("i8")
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else np.zeros(1, "i8")
    rows: dict[str, list] = {name: [] for name in _PACKED.names}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        v, place = np.unique(values[a:b], return_inverse=True)
        known = np.zeros(len(v), bool)
        known[place[seed[a:b]]] = True
        edges = place.astype("u8") * np.uint64(n_patterns) + patterns[a:b].astype("u8")
        for name, x in zip(rows, (int(of[a]), len(v), b - a, coded(v), coded(edges), shut(np.packbits(known).tobytes())), strict=True):
            rows[name].append(x)
    return pa.table(rows, schema=_PACKED)


def _unpacked_edges(table: pa.Table | pa.RecordBatch, n_patterns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row: the values, each edge's value as a place in these, each edge's pattern, which values are seeds."""
    for _, n_values, n, values, edges, known in zip(*(table.column(c).to_pylist() for c in _PACKED.names), strict=True):
        place, pattern = np.divmod(decoded(edges, n), np.uint64(n_patterns))
        yield decoded(values, n_values), place.astype("i8"), pattern.astype("i8"), np.unpackbits(np.frombuffer(opened(known), "u1"), count=n_values).astype(bool)


def edges(docs: DataFrame, slots: Slots, n_ranges: int) -> DataFrame:
    """The different edges of open patterns, packed, a row for each range of values."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    n_patterns = len(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, waiting, size = shared.value, [], 0
        for batch in _gathered(batches):
            raw, coded_, base = _read(batch)
            _, _, _, value, which = slots.tokens(coded_, base)
            places = [((which[:, i] >= 0), i) for i in (0, 1)]
            waiting += [(value[hit], which[hit, i], np.zeros(int(hit.sum()), bool)) for hit, i in places]
            seen = []
            for t, spans in zip(raw, base, strict=True):
                if spans:
                    context = Context(t)
                    seen += [(_number(t[a:b].lower()), p) for _, a, b in spans for p in context.patterns(a, b)[1:]]
            seen = np.array(seen, "u8").reshape(-1, 2)
            at = slots.places(seen[:, 1])
            waiting.append((seen[at >= 0, 0], at[at >= 0], np.ones(int((at >= 0).sum()), bool)))
            size = sum(len(w[0]) for w in waiting)
            if size > MOST_EDGES:
                waiting = [_sorted_edges(*map(np.concatenate, zip(*waiting, strict=True)))]
                if len(waiting[0][0]) > MOST_EDGES // 2:
                    yield from _packed_edges(*waiting[0], n_patterns, n_ranges).to_batches()
                    waiting = []
        if waiting:
            yield from _packed_edges(*_sorted_edges(*map(np.concatenate, zip(*waiting, strict=True))), n_patterns, n_ranges).to_batches()

    def met(table: pa.Table) -> pa.Table:
        parts = [(values[place], pattern, known[place]) for values, place, pattern, known in _unpacked_edges(table, n_patterns)]
        return _packed_edges(*_sorted_edges(*map(np.concatenate, zip(*parts, strict=True))), n_patterns, n_ranges)

    return texts(docs).select("text").mapInArrow(tidied_batches(run), _EDGES).groupBy("range").applyInArrow(tidied(met), _EDGES).checkpoint()


def confidences(graph: DataFrame, n_patterns: int, rounds: int = ROUNDS) -> np.ndarray:
    """The last confidence of each open pattern, from ``edges``: the same as in ``bootstrap``."""
    out = None
    for _ in range(rounds):
        shared = graph.sparkSession.sparkContext.broadcast(out)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            before, sums, sizes = shared.value, np.zeros(n_patterns), np.zeros(n_patterns, "i8")
            for batch in batches:
                for values, place, pattern, known in _unpacked_edges(batch, n_patterns):
                    score = known.astype(float)
                    if before is not None:
                        doubt = np.bincount(place, np.log(np.maximum(1e-6, 1 - before[pattern])), len(values))
                        score = np.where(known, 1.0, 1 - np.exp(doubt))
                    sums += np.bincount(pattern, score[place], n_patterns)
                    sizes += np.bincount(pattern, minlength=n_patterns)
            there = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there]), pa.array(sizes[there])], names=["pattern", "score", "n"])

        rows = graph.mapInArrow(tidied_batches(run), "pattern long, score double, n long").groupBy("pattern").agg((F.sum("score") / (F.sum("n") + SHRINK)).alias("confidence")).toArrow()
        out = np.zeros(n_patterns)
        out[rows.column("pattern").to_numpy()] = rows.column("confidence").to_numpy()
    return out


def _lists(text: np.ndarray, fields: list[np.ndarray], n: int) -> pa.Array:
    """A list of spans for each of ``n`` texts, from spans in the order of texts."""
    ends = np.cumsum(np.bincount(text, minlength=n))
    spans = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(fields, _SPAN, strict=True)], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), spans)


def marked(docs: DataFrame, slots: Slots) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every text; tokens in the slots are of kind ``context``."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in _gathered(batches):
            _, coded_, base = _read(batch)
            n = batch.num_rows
            own = np.repeat(np.arange(n), [len(s) for s in base])
            flat = np.array([s for spans in base for s in spans], "i8").reshape(-1, 3)
            text, start, end = slots.tokens(coded_, base)[:3] if len(slots) else (np.zeros(0, "i8"),) * 3
            every = np.concatenate([flat, np.stack([np.full(len(text), KINDS.index("context")), start, end], 1)])
            of = np.concatenate([own, text])
            order = np.argsort(of, kind="stable")
            lists = [_lists(own, list(flat.T), n), _lists(of, list(every[order].T), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "base", "spans"])

    source = texts(docs)
    span = "array<struct<kind:int,start:bigint,end:bigint>>"
    return source.mapInArrow(tidied_batches(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, base {span}, spans {span}")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (by kind, then start) of every text."""
    prepare(docs.sparkSession)
    support = seeds(docs).groupBy("pattern", "before", "value").agg(F.lit(1).alias("one")).groupBy("pattern", "before").agg(F.count("*").alias("seeds"))
    open_ = support.where(F.col("seeds") >= LEAST_SEEDS).select("pattern", "before").checkpoint()
    if open_.count() > MOST_OPEN:
        return _scan_by_rows(docs, open_)
    rows = open_.toArrow()
    slots = Slots(*(rows.column(c).to_numpy().view("u8") for c in ("pattern", "before")))
    if not len(slots):
        return marked(docs, slots)
    graph = edges(docs, slots, blocks_for(total_bytes(texts(docs)), RANGE_BYTES))
    passed = confidences(graph, len(slots)) >= LEAST_CONFIDENCE
    return marked(docs, Slots(slots.patterns[passed], slots.before[passed]))


def _scan_by_rows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """The same by a row for each mention, for any number of ``opened`` patterns."""
    found = extract(docs, field(opened, "pattern"), field(opened, "before"))
    passed = bootstrap(found, opened.select("pattern"))
    unseen = found.select("row", F.explode("mentions").alias("m")).where(~F.col("m.seed")).select("row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    more = unseen.join(passed, "pattern").select("row", F.struct(F.lit(4).alias("kind"), "start", "end").alias("s")).groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("more"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return found.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", "base", F.concat("base", F.coalesce("more", none)).alias("spans"))


def joined(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``: counts of the base kinds, digest of the base spans, all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(of(i).alias(f"n_{KINDS[i]}") for i in range(4)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
