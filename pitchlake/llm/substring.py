"""Removal of long word runs that occur more than once, by compressed FM-indexes over shards of documents.

A shard is a block of whole documents. Its FM-index is the Burrows-Wheeler
transform of their words in a wavelet matrix of packed bits with rank
directories, and a sample of the suffix array. Backward search gives matching
statistics of runs of words that stream against it: how far back from a place
they still occur in the shard, and where.

Not every document can meet every shard. Every run of ``window`` words is hashed
and counted over the whole input (see ``blocks``), only to choose the way: the
shards that hold a hash ask each other, each another one, at most
``blocks.ARITY`` the same. Neighbouring runs on one way travel as one piece, and
equal pieces of a shard once, with all their places. Where a piece's matching
statistics reach ``window``, the interval is repeated in the shard that asked and
at the places found in the shard that was asked; runs that a shard holds twice
are searched for in its own index, two occurrences at least. Blocks cut
the reported intervals from their documents.

Edge cases: null and empty texts have no words and keep the empty text; texts
shorter than a window keep all words; repeated rows repeat each other; a run
that repeats inside one document, overlapping itself or not, counts. Nothing is
removed that the index did not find; a repeat can be missed only where different
runs share a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Plan, U, Words, counted, in_blocks, ranks, sorted_block
from .common import prepare, texts, tidied_pair, total_bytes

WINDOW = 35
BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 16 << 20
#: The most runs of one piece, and every so many-th place of the suffix array that an index keeps.
MOST, SAMPLED = 128, 16


#: The bits below each place of a word.
_BELOW = (U(1) << np.arange(64, dtype="u8")) - U(1)


class Bits:
    """Packed bits with counts every 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, "u1")
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype="i8")[:-1]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        return self.counts[block] + np.bitwise_count(self.words[block] & _BELOW[at & 63])

    def at(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype("u8")) & U(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence: a level of packed bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among equal symbols, on the last level."""
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where it lies on the last level."""
        symbols = np.zeros(len(at), "i8")
        for bit, bits, zeros in self.levels:
            ones, set_ = bits.rank(at), bits.at(at)
            symbols |= set_.astype("i8") << bit
            at = np.where(set_, zeros + ones, at - ones)
        return symbols, at


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling; zeros are separators, each unlike all others and before all symbols."""
    n, m = len(text), int((text == 0).sum())
    rank = text + m - 1
    rank[text == 0] = np.arange(m)
    order = np.argsort(rank, kind="stable")
    places, step = np.arange(n), 0  # the places of the order that are not settled yet
    while True:
        at = order[places]
        later = np.zeros(len(at), "i8")
        if step:
            inside = at + step < n
            later[inside] = rank[at[inside] + step] + 1
        key = rank[at] * (max(n, int(rank.max(initial=0))) + 2) + later
        sub = np.argsort(key)
        key, at = key[sub], at[sub]
        order[places] = at
        fresh = np.diff(key, prepend=-1) != 0
        heads = places[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        rank[at] = heads
        alone = fresh & np.append(fresh[1:], True)
        places = places[~alone]
        if not len(places):
            return order
        step = max(1, 2 * step)


class FmIndex:
    """Backward search in a set of word sequences. tokens: symbols from 1; lengths: of the sequences."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths)
        self.starts = ends - lengths + np.arange(len(lengths))  # in the text with a separator after each sequence
        self.n = len(tokens) + len(lengths)
        text = np.zeros(self.n, "i8")
        text[np.arange(len(tokens)) + np.repeat(np.arange(len(lengths)), lengths)] = tokens
        top = int(tokens.max(initial=0))
        order = suffix_array(text)
        before = text[order - 1]
        kept = (order % SAMPLED == 0) | (before == 0)
        self.kept, self.sample = Bits(kept), order[kept].astype("i4")
        self.wavelet = WaveletMatrix(before, top)
        counts = np.bincount(text, minlength=top + 1)
        self.base = np.cumsum(counts) - counts - self.wavelet.follow(np.arange(top + 1), np.zeros(top + 1, "i8"))

    def stretches(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, least: int) -> tuple[np.ndarray, ...]:
        """Matching statistics of pieces of ``symbols`` (0: not in the index) that reach ``window``.

        From the end of each piece backwards: the longest stretch with at least
        ``least`` occurrences, then the same from the last place whose run of
        ``window`` is not inside it. Gives piece, start, end and the interval of rows.
        """
        piece = np.flatnonzero(ends - starts >= window)
        end = ends[piece]
        at, low, high = end.copy(), np.zeros(len(piece), "i8"), np.full(len(piece), self.n)
        found = []
        while len(piece):
            c = symbols[at - 1]
            both = self.wavelet.follow(np.concatenate([c, c]), np.concatenate([low, high])) + np.concatenate([self.base[c]] * 2)
            new_low, new_high = both[: len(c)], both[len(c) :]
            going = (c > 0) & (new_high - new_low >= least)
            low, high, at = np.where(going, new_low, low), np.where(going, new_high, high), at - going
            stop = ~going | (at == starts[piece])
            if stop.any():
                s = np.flatnonzero(stop)
                long = s[end[s] - at[s] >= window]
                found.append((piece[long], at[long], end[long], low[long], high[long]))
                end[s] = np.minimum(end[s] - 1, at[s] - 1 + window)
                at[s], low[s], high[s] = end[s], 0, self.n
                keep = ~stop
                keep[s] = ~going[s] & (end[s] - starts[piece[s]] >= window)
                piece, at, end, low, high = piece[keep], at[keep], end[keep], low[keep], high[keep]
        return tuple(np.concatenate([np.zeros(0, "i8"), *x]) for x in (zip(*found, strict=True) if found else ((),) * 5))

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and place of each row: steps back to the nearest row whose place is kept."""
        places, steps, index = np.empty(len(rows), "i8"), 0, np.arange(len(rows))
        while len(rows):
            hit = self.kept.at(rows)
            places[index[hit]] = self.sample[self.kept.rank(rows[hit])] + steps
            index, rows = index[~hit], rows[~hit]
            c, at = self.wavelet.read(rows)
            rows, steps = self.base[c] + at, steps + 1
        which = np.searchsorted(self.starts, places, side="right") - 1
        return which, places - self.starts[which]


def _words(table: pa.Table) -> Words:
    return Words.of([t.as_buffer().to_pybytes() for t in table.column("text")])


def _ask(window: int):
    def ask(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_words(table).windows(window), return_counts=True)

    return ask


def _runs(starts: np.ndarray, same: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of pieces: at most MOST neighbouring ``starts`` of windows with the same value."""
    fresh = (np.diff(starts, prepend=-2) != 1) | (np.diff(same, prepend=same[:1]) != 0)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))
    fresh |= (np.arange(len(starts)) - head) % MOST == 0
    heads = np.flatnonzero(fresh)
    return starts[heads], starts[heads] + np.diff(np.append(heads, len(starts))) + window - 1


def _document(words: Words, at: np.ndarray) -> np.ndarray:
    """The text that each word stands in. Texts without words share a start with the next one: the last of these is the text."""
    return np.searchsorted(words.starts, at, side="right") - 1


_ASKED = pa.schema([("home", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("copies", pa.binary()), ("origins", pa.binary())])


def _asked(window: int):
    def finish(table: pa.Table, block: int, parents: np.ndarray) -> pa.Table:
        """A row for each shard that this one asks: its distinct pieces as numbered words, and their places."""
        words = _words(table)
        hashes = words.windows(window)
        homes = parents[ranks(hashes)]
        places = words.gram_places(window)
        firsts, ends = _runs(places[homes >= 0], homes[homes >= 0], window)
        docs = _document(words, firsts)
        within = firsts - words.starts[docs]
        home = homes[np.searchsorted(places, firsts)]
        rows: dict[str, list] = {name: [] for name in _ASKED.names}
        for h in np.unique(home).tolist():
            mine = np.flatnonzero(home == h)
            pieces: dict[bytes, list[tuple[int, int]]] = {}
            for a, b, doc, at in zip(*(x[mine].tolist() for x in (firsts, ends, docs, within)), strict=True):
                pieces.setdefault(words.ids[a:b].tobytes(), []).append((doc, at))
            used, ids = np.unique(np.frombuffer(b"".join(pieces), "i4"), return_inverse=True)
            values = (
                h, block, b" ".join([words.vocabulary[i] for i in used.tolist()]), ids.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(),
                np.array([len(p) // 4 for p in pieces], "<i4").tobytes(), np.array([len(v) for v in pieces.values()], "<i4").tobytes(), np.array([p for v in pieces.values() for p in v], "<i4").tobytes(),
            )
            for name, value in zip(rows, values, strict=True):
                rows[name].append(value)
        return pa.table(rows, schema=_ASKED)

    return finish


def _matched(window: int):
    def match(table: pa.Table, asked: pa.Table) -> pa.Table:
        """For this shard and those that asked: document, first word and end of the repeated intervals."""
        words = _words(sorted_block(table)) if table.num_rows else Words.of([])
        hashes = words.windows(window)
        order = np.argsort(hashes)
        equal = np.diff(hashes[order]) == 0
        twice = np.zeros(len(hashes), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        del hashes, order, equal
        spans: dict[int, list[np.ndarray]] = {}
        if asked.num_rows or twice.any():
            tokens = words.ids.astype("i8") + 1
            index = FmIndex(tokens, words.lengths)
        if twice.any():
            starts = words.gram_places(window)[twice]
            firsts, ends = _runs(starts, np.zeros(len(starts), "i8"), window)
            _, a, b, _, _ = index.stretches(tokens, firsts, ends, window, 2)
            docs = _document(words, a)
            spans.setdefault(table.column("block")[0].as_py(), []).append(np.stack([docs, a - words.starts[docs], b - words.starts[docs]], 1))
        if asked.num_rows:
            number = {w: i + 1 for i, w in enumerate(words.vocabulary)}
            symbols, sizes, copies, origins, blocks = [], [], [], [], []
            for block, known, ids, size, n, places in zip(*(asked.column(c).to_pylist() for c in ("block", "words", "ids", "sizes", "copies", "origins")), strict=True):
                own = np.array([number.get(w, 0) for w in known.split()], "i8")
                sizes.append(np.frombuffer(size, "<i4"))
                symbols.append(own[np.frombuffer(ids, "<u2" if len(own) <= 1 << 16 else "<u4")])
                copies.append(np.frombuffer(n, "<i4"))
                origins.append(np.frombuffer(places, "<i4").reshape(-1, 2))
                blocks.append(np.full(len(copies[-1]), block))
            symbols, sizes, copies, origins, blocks = map(np.concatenate, (symbols, sizes, copies, origins, blocks))
            ends = np.cumsum(sizes)
            piece, a, b, low, high = index.stretches(symbols, ends - sizes, ends, window, 1)
            # the places of each piece that asked
            first = (np.cumsum(copies) - copies)[piece]
            each = np.repeat(np.arange(len(piece)), copies[piece])
            origin = origins[np.repeat(first, copies[piece]) + np.arange(len(each)) - np.repeat(np.cumsum(copies[piece]) - copies[piece], copies[piece])]
            lead = origin[:, 1] - (ends - sizes)[piece[each]]
            out, owner = np.stack([origin[:, 0], lead + a[each], lead + b[each]], 1), blocks[piece[each]]
            by_owner = np.argsort(owner, kind="stable")
            edges = np.flatnonzero(np.diff(owner[by_owner], prepend=-1, append=-1)) if len(owner) else np.zeros(1, "i8")
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                spans.setdefault(int(owner[by_owner[x]]), []).append(out[by_owner[x:y]])
            # and the places where they were found
            found = np.unique(np.stack([low, high, b - a], 1), axis=0)
            times = found[:, 1] - found[:, 0]
            rows = np.repeat(found[:, 0], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            docs, at = index.locate(rows)
            spans.setdefault(table.column("block")[0].as_py(), []).append(np.stack([docs, at, at + np.repeat(found[:, 2], times)], 1))
        kept = {block: np.unique(np.concatenate(s), axis=0) for block, s in spans.items()}
        return pa.table({"block": pa.array(list(kept), pa.int64()), "spans": pa.array([s.astype("<i4").tobytes() for s in kept.values()], pa.binary())})

    return match


def _cut(table: pa.Table, replies: pa.Table) -> pa.Table:
    table = sorted_block(table)
    spans = np.concatenate([np.zeros((0, 3), "<i4"), *(np.frombuffer(s, "<i4").reshape(-1, 3) for s in replies.column("spans").to_pylist())])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    at = np.searchsorted(spans[:, 0], np.arange(table.num_rows + 1))
    n_words, n_removed, kept = [], [], []
    for i, t in enumerate(table.column("text")):
        words = t.as_buffer().to_pybytes().split()
        n_words.append(len(words))
        if at[i] < at[i + 1]:
            change = np.zeros(len(words) + 1, "i8")
            np.add.at(change, spans[at[i] : at[i + 1], 1], 1)
            np.add.at(change, spans[at[i] : at[i + 1], 2], -1)
            stays = np.cumsum(change[:-1]) == 0
            n_removed.append(len(words) - int(stays.sum()))
            words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
        else:
            n_removed.append(0)
        kept.append(b" ".join(words))
    for name, values in (("n_words", pa.array(n_words, pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("kept", pa.array(kept, pa.binary()).cast(pa.string()))):
        table = table.append_column(name, values)
    return table


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` (``doc_id``, ``text`` and more) and ``n_words, n_removed, kept``; kept words are joined by one space.

    The three names and ``block`` must be free.
    """
    if taken := {"block", "n_words", "n_removed", "kept"} & set(docs.columns):
        raise ValueError(f"the names {sorted(taken)} must be free")
    prepare(docs.sparkSession)
    plan = Plan.fit(total_bytes(docs), BLOCK_BYTES, BUCKET_BYTES)
    blocked = in_blocks(docs, plan)
    asked = counted(blocked, plan, _ask(window), _asked(window), "home long, block long, words binary, ids binary, sizes binary, copies binary, origins binary", holders=True)
    spans = blocked.groupBy("block").cogroup(asked.groupBy("home")).applyInArrow(tidied_pair(_matched(window)), "block long, spans binary")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return blocked.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(tidied_pair(_cut), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without the words of repeated runs of 35."""
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
