"""Packing of token sequences: optimal length buckets, then batches of a token budget.

Each text's tokens (words) are cut into sequences of at most ``max_tokens``. A
global histogram of sequence lengths, at most ``max_tokens`` numbers, goes to
the driver, where dynamic programming places the bucket boundaries so that
padding every sequence to its bucket's length costs least. A bucket of length b
takes ``budget // b`` sequences a batch. Batches form inside groups of a bucket
and a salt; there are as many salts as keep a group near ``group_rows``, known
from the histogram, so a bucket with most rows is many groups. Each group has
at most one batch that is not full.

Edge cases: a null or empty text is one sequence of no tokens, without bucket
or batch (null); an empty table gives an empty result; repeated rows are
sequences of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, texts, tidied_batches

MAX_TOKENS = 2048
BUCKETS = 8
BUDGET = 16_384
GROUP_ROWS = 20_000


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Bucket lengths, ascending, at most ``buckets`` of them, that cost least padding.

    histogram: how many sequences have each length. The largest length is always a boundary.
    """
    lengths = np.array(sorted(histogram), "i8")
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], "i8")
    rows, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * lengths))
    n = len(lengths)
    best = np.full(n + 1, np.iinfo("i8").max // 4)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        now, choice = np.full(n + 1, np.iinfo("i8").max // 4), np.zeros(n + 1, "i8")
        now[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            choice[j] = i = int(cost.argmin())
            now[j] = cost[i]
        best = now
        choices.append(choice)
    found, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        found.append(int(lengths[j - 1]))
        j = int(choice[j])
    return found[::-1]


def token_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``n_tokens``: words separated by ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(t.as_buffer().to_pybytes().split()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    source = texts(docs)
    return source.mapInArrow(tidied_batches(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row a sequence: ``doc_id, piece, first_token, n_tokens, bucket_tokens, batch_id, slot``."""
    if budget < max_tokens:
        raise ValueError("a batch must have room for the longest sequence")
    prepare(docs.sparkSession)
    # rows are dealt by a number of their own, fixed by the checkpoint: equal ids do not meet in one group
    counts = token_counts(docs).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / max_tokens).cast("int") - 1)))
    pieces = counts.select("row", "doc_id", piece.alias("piece"), "n_tokens").select(
        "row", "doc_id", "piece", (F.col("piece").cast("long") * max_tokens).alias("first_token"), F.least(F.col("n_tokens") - F.col("piece").cast("long") * max_tokens, F.lit(max_tokens)).cast("int").alias("n_tokens")
    )
    histogram = {r["n_tokens"]: r["count"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    ends = boundaries(histogram, buckets)
    bucket = F.lit(None).cast("int")
    salts = F.lit(1)
    for i in reversed(range(len(ends))):
        within = sum(c for x, c in histogram.items() if (ends[i - 1] if i else 0) < x <= ends[i])
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(ends[i])).otherwise(bucket)
        salts = F.when(F.col("n_tokens") <= ends[i], F.lit(-(-within // group_rows))).otherwise(salts)
    placed = pieces.withColumn("bucket_tokens", F.when(F.col("n_tokens") > 0, bucket))
    placed = placed.withColumn("salt", F.when(F.col("n_tokens") > 0, F.pmod(F.xxhash64("row", "piece"), salts.cast("bigint"))).cast("int"))
    full, rest = placed.where("n_tokens > 0"), placed.where("n_tokens = 0")
    number = F.row_number().over(W.partitionBy("bucket_tokens", "salt").orderBy("doc_id", "piece", "n_tokens", "row")) - 1
    room = F.floor(F.lit(budget) / F.col("bucket_tokens")).cast("int")
    numbered = full.withColumn("number", number)
    batch = F.concat_ws("-", "bucket_tokens", "salt", F.floor(F.col("number") / room).cast("long"))
    out = numbered.select("doc_id", "piece", "first_token", "n_tokens", "bucket_tokens", batch.alias("batch_id"), (F.col("number") % room).alias("slot"))
    return out.unionByName(rest.select("doc_id", "piece", "first_token", "n_tokens", "bucket_tokens", F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("int").alias("slot")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` in length buckets and batches."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
