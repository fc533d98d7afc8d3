"""The corpus pipeline: documents in, batches of token sequences out.

Each stage calls one operator of ``pitchlake.llm``; its result is written as
Parquet and read again as the next stage's documents. All stages but the last
return the columns of ``documents``, ``n_chars`` brought up to date.

Edge cases: null texts and texts without a letter go in the first stage; without
any label no language can be told and every text with a letter stays; of repeated
rows one stays; a null id stands for no group, so of a group of null ids only each
different text stays; empty tables pass through; other columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import langid, ngram_join, packing, secrets, substring
from pitchlake.llm.common import prepare, texts

#: Below this probability of the likeliest language a document is in none.
LEAST_SCORE = 0.3
#: Near duplicates: five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: Runs of so many words that occur more than once are cut.
WINDOW = 50
#: A struct of a document's other columns; no column of ``documents`` has this name.
_REST = "rest_of_row"


def _renewed(docs: DataFrame, changed: DataFrame, text: Column) -> DataFrame:
    """Rows of ``changed`` with the columns of ``docs``: ``text`` new, ``n_chars`` its length, others from the struct."""
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return changed.select(*((new[c] if c in new else F.col(f"{_REST}.{c}")).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter, or in no likely language, go. Without labels all others stay."""
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select("text", F.struct("*").alias(_REST))
    kept = langid.predict(rows, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"{_REST}.{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, stays."""
    found = ngram_join.join(texts(docs), SHINGLE, PERCENT)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay_id"), F.col("h").alias("stay_h")).distinct()
    rows = docs.select(F.struct("*").alias(_REST), F.col("doc_id").alias("row_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("row_h"))
    kept = rows.join(stay, F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_h") == F.col("stay_h")), "left_semi")
    return kept.dropDuplicates(["row_id", "row_h"]).select(*(F.col(f"{_REST}.{c}").alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; those of nothing else go."""
    rest = F.struct(*(c for c in docs.columns if c not in ("text", "n_chars"))).alias(_REST)
    cut = substring.remove_repeats(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rest), WINDOW)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _renewed(docs, kept, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    found = secrets.redact(secrets.scan(docs, secrets.train(docs), keep=True)).withColumnRenamed("payload", _REST)
    return _renewed(docs, found, F.col("text"))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in length buckets and batches of a token budget."""
    return packing.pack(docs)


STAGES = [
    ("language identification", language),
    ("near duplicates", near_duplicates),
    ("substring deduplication", repeated_passages),
    ("secret scan", secret_values),
    ("packing", batches),
]

#: Language models and optimal buckets are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written under the shared checkpoint folder."""
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    raise AssertionError("no stages")
