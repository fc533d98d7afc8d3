"""Language-model scores of whole texts by a weighted backoff automaton over words.

States are the empty context and each run of up to ``order - 1`` words of the
training texts (a start stands before each text). A state has an arc for each
word seen after it, and a failure arc to the state of its last words but the
first. With Dirichlet smoothing of weight m for contexts of a length, the arc of
w from the state u weighs (c(uw) + m p(w | fail(u))) / (c(u) + m), the failure arc
m / (c(u) + m), and the empty context's arcs (c(w) + 1) / (N + V + 1): all weights
of a state sum to one, with one share for all unknown words together. An
arc leads to the longest state that ends what was read.

A text is read once from left to right: each word takes an arc of the present
state, or fails, as often as it must, and then takes one; the logarithms add up.
All texts of a block are read side by side, long ones in segments; a segment's
state comes from reading the ``order - 1`` words before it, which is exact.

The automaton is never in one place: its counts are sums over all
training texts, kept in hash ranges, and each block of documents builds the
states and arcs that its own texts can meet (see ``blocks``).

Edge cases: null and empty texts consist of the end alone; without training
texts every probability is that of an unknown word (1, so scores are 0); a null
``doc_id`` counts as not held out; repeated rows count and score each. Leading
bits of hashes stand for n-grams, so about one count in a million may be too high
(words have two hashes, and the lower count holds).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Plan, Words, counted, in_blocks, mixed
from .common import prepare, texts, tidied_batches, total_bytes

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: The most words of an arc and its state, and the smoothing of contexts of one word, of two and so on (best held-out likelihood of those tried on 4,000 documents).
ORDER = 3
SMOOTHING = (1000.0, 20.0)
#: Words of a text that are read in one go.
SEGMENT = 256
#: So many bits more than the input's bytes travel of a hash.
SPARE_BITS, LEAST_BITS = 18, 48
#: No word has white space, so neither mark can be one.
START, END = b" start", b" end"


def _words(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a block, each text with the start before and the end after it; held-out rows; is a place in such a row."""
    raw = [b"\x00 " + t.as_buffer().to_pybytes().lower() + b" \x00" for t in table.column("text")]
    words = Words.of(raw)
    first = np.zeros(len(words.ids), bool)
    first[words.starts] = True
    # the two marks stand at the ends of each text and get hashes of their own
    import xxhash

    n = len(words.hashes)
    ids = words.ids.copy()
    ids[words.starts] = n
    ids[words.starts + words.lengths - 1] = n + 1
    hashes = np.append(words.hashes, np.array([xxhash.xxh3_64_intdigest(START), xxhash.xxh3_64_intdigest(END)], "u8"))
    held = np.array(table.column("held_out").to_pylist(), bool)
    return Words(ids, words.lengths, [], hashes), held, np.repeat(held, words.lengths)


class Grams:
    """The runs of up to ``order`` words of a block: at each place the number of the run that ends there (-1: none)."""

    def __init__(self, words: Words, order: int):
        v = len(words.hashes)
        within = np.arange(len(words.ids)) - np.repeat(words.starts, words.lengths)
        self.at, self.hashes, self.suffix = [words.ids.astype("i8")], [words.hashes], [np.zeros(v, "i8")]
        for n in range(2, order + 1):
            places = np.flatnonzero(within >= n - 1)
            codes, number = np.unique(self.at[-1][places - 1] * v + self.at[0][places], return_inverse=True)
            at = np.full(len(within), -1)
            at[places] = number
            suffix = np.empty(len(codes), "i8")
            suffix[number] = self.at[-1][places]
            self.hashes.append(mixed(self.hashes[-1][codes // v], words.hashes[codes % v]))
            self.at.append(at)
            self.suffix.append(suffix)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A key for each run, two for each word that occurs, and which words these are."""
        used = np.flatnonzero(np.bincount(self.at[0], minlength=len(self.hashes[0])))
        ones = self.hashes[0][used]
        parts = [mixed(np.full(len(h), n, "u8"), h) for n, h in ((1, ones), (0, ones), *enumerate(self.hashes[1:], 2))]
        return np.concatenate(parts), used

    def counts(self, totals: np.ndarray, used: np.ndarray) -> list[np.ndarray]:
        """How often each run of 1, 2 and more words occurs, from totals in the order of the keys."""
        n = len(used)
        ones = np.zeros(len(self.hashes[0]), "i8")
        ones[used] = np.minimum(totals[:n], totals[n : 2 * n])
        cuts = 2 * n + np.cumsum([len(h) for h in self.hashes[1:-1]], dtype="i8")
        return [ones, *np.split(totals[2 * n :], cuts - 2 * n)]


class Automaton:
    """States of the runs that a block's texts can meet: 0 is the empty context, then runs of one word, of two, ..."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], smoothing: tuple[float, ...], base: np.ndarray):
        order = len(counts)
        self.grams = grams
        self.offset = np.concatenate([[0, 1], 1 + np.cumsum([len(c) for c in counts[: order - 1]])])[: order + 1]
        #: Of each run of n words: the weight of the arc that ends it, and the state that the arc leads to.
        self.weight, self.target, self.seen = [base], [], []
        level, fail, fail_weight = [np.zeros(1, "i8")], [np.zeros(1, "i8")], [np.zeros(1)]
        for n, c in enumerate(counts, 1):
            self.seen.append(c > 0 if n > 1 else np.ones(len(c), bool))
            longest = np.where(c > 0, self.offset[n] + np.arange(len(c)), 0) if n < order else self.offset[n - 1] + grams.suffix[n - 1]
            self.target.append(longest)
            if n < order:
                m = smoothing[n - 1]
                level.append(np.full(len(c), n))
                fail.append(self.offset[n - 1] + grams.suffix[n - 1] if n > 1 else np.zeros(len(c), "i8"))
                fail_weight.append(np.log10(m / (c + m)))
        self.level, self.fail, self.fail_weight = map(np.concatenate, (level, fail, fail_weight))
        for n in range(2, order + 1):
            # the prefix of a run is its state; the lower probability is that of the run's last words
            m, c = smoothing[n - 2], counts[n - 1]
            below = 10.0 ** self.weight[-1][grams.suffix[n - 1]]
            context = np.zeros(len(c), "i8")
            places = np.flatnonzero(grams.at[n - 1] >= 0)
            context[grams.at[n - 1][places]] = counts[n - 2][grams.at[n - 2][places - 1]]
            self.weight.append(np.log10((c + m * below) / (context + m)))

    def read(self, starts: np.ndarray, run_in: np.ndarray, stops: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Log-probabilities of the words of stretches of places, read side by side; those of the first ``run_in`` words are not added."""
        order = np.argsort(starts - stops, kind="stable")
        at, skip, stops, state = starts[order], (starts + run_in)[order], stops[order], states[order]
        total = np.zeros(len(at))
        while (n := int((at < stops).sum())) > 0:  # the longest stretches come first
            place, scored = at[:n], at[:n] >= skip[:n]
            now, step, waiting = state[:n].copy(), np.zeros(n), np.arange(n)
            while len(waiting):
                s, p = now[waiting], place[waiting]
                taken = np.zeros(len(waiting), bool)
                for k, (runs, weight, target, seen) in enumerate(zip(self.grams.at, self.weight, self.target, self.seen, strict=True)):
                    mine = np.flatnonzero(self.level[s] == k)
                    run = runs[p[mine]]
                    arc = seen[run] & (run >= 0)
                    goes, run = waiting[mine[arc]], run[arc]
                    step[goes] += weight[run]
                    now[goes] = target[run]
                    taken[mine[arc]] = True
                waiting, s = waiting[~taken], s[~taken]
                step[waiting] += self.fail_weight[s]
                now[waiting] = self.fail[s]
            state[:n] = now
            total[:n] += np.where(scored, step, 0.0)
            at[:n] += 1
        out = np.empty(len(total))
        out[order] = total
        return out


def _ask(order: int):
    def ask(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        words, _, held = _words(table)
        grams = Grams(words, order)
        keys, used = grams.keys()
        counts = [np.bincount(at[(at >= 0) & ~held], minlength=len(h)) for at, h in zip(grams.at, grams.hashes, strict=True)]
        counts = np.concatenate([counts[0][used], counts[0][used], *counts[1:]])
        by_key = np.argsort(keys)
        return keys[by_key], counts[by_key]

    return ask


def _finish(order: int, smoothing: tuple[float, ...], n_train: int, v_train: int):
    def finish(table: pa.Table, block: int, totals: np.ndarray) -> pa.Table:
        words, _, _ = _words(table)
        grams = Grams(words, order)
        keys, used = grams.keys()
        found = np.empty(len(keys), "i8")
        found[np.argsort(keys)] = totals
        del keys, totals
        counts = grams.counts(found, used)
        base = np.log10((counts[0] + 1.0) / (n_train + v_train + 1.0))
        automaton = Automaton(grams, counts, smoothing, base)
        # segments of each text, behind its start; the first has the start's state, others read the words before them
        lengths = words.lengths - 1
        pieces = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = words.starts[text] + 1 + number * SEGMENT
        stops = np.minimum(first + SEGMENT, words.starts[text] + words.lengths[text])
        run_in = np.where(number > 0, min(order - 1, SEGMENT), 0)
        states = np.where(number == 0, automaton.target[0][words.ids[words.starts[text]]], 0) if len(text) else first
        scores = automaton.read(first - run_in, run_in, stops, states)
        word = words.ids[np.setdiff1d(np.arange(len(words.ids)), words.starts, assume_unique=True)]
        starts = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has its end
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held_out"),
                "n_tokens": lengths,
                "n_known": add((counts[0][word] > 0).astype("i8")),
                "train_tokens": np.full(len(lengths), n_train),
                "base_score": add(base[word]),
                "score": np.bincount(text, weights=scores, minlength=len(lengths)),
            }
        )

    return finish


def training_size(docs: DataFrame) -> tuple[int, int]:
    """How many tokens, and distinct tokens, the rows not held out have, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, tokens = [], 0, 0

        def out() -> pa.RecordBatch:
            """Distinct words; the first carries the number of tokens."""
            words = np.unique(np.concatenate(seen))
            return pa.RecordBatch.from_arrays([pa.array(words.view("i8")), pa.array(np.where(np.arange(len(words)) == 0, tokens, 0))], names=["word", "n"])

        def learn() -> None:
            nonlocal held, tokens
            words = Words.of(waiting)
            seen.append(words.hashes)
            held, tokens = held + len(words.hashes), tokens + len(words.ids)
            waiting.clear()

        waiting: list[bytes] = []
        size = 0
        for batch in batches:
            for t in batch.column("text"):
                waiting.append(t.as_buffer().to_pybytes().lower())
                size += len(waiting[-1])
                if size >= BLOCK_BYTES:  # few words are new in much text
                    learn()
                    size = 0
            if held > 2_000_000:
                yield out()
                seen, held, tokens = [], 0, 0
        if waiting:
            learn()
        if held:
            yield out()

    kept = docs.where(~F.col("held_out"))
    n, v = kept.select("text").mapInArrow(tidied_batches(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = kept.count()
    return n + ends, v + (ends > 0)


def score(docs: DataFrame, order: int = ORDER, smoothing: tuple[float, ...] = SMOOTHING) -> DataFrame:
    """Scores of ``docs`` (``doc_id``, ``text``, boolean ``held_out``); rows not held out train the automaton.

    order: 2 and more; smoothing: a weight for each length of contexts, from 1 to order - 1.
    """
    if order < 2 or len(smoothing) != order - 1:
        raise ValueError("order is 2 or more, with a smoothing weight for each length of contexts")
    prepare(docs.sparkSession)
    plan = Plan.fit(total_bytes(docs), BLOCK_BYTES, BUCKET_BYTES, SPARE_BITS, LEAST_BITS)
    n, v = training_size(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counted(in_blocks(docs, plan), plan, _ask(order), _finish(order, smoothing, n, v), schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text of ``documents``; a seventh of them, by crc32 of the id, is held out."""
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs.withColumn("held_out", held))
