"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python: long texts make batches heavy.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the Python stages need: small Arrow batches, a checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used as it stands (it is the
    one that driver and executors share); only a local session without it, as in
    tests, gets a folder of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "pitchlake-checkpoints"))
    return spark


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage between two phases: only then does Spark delete their shuffle files and dropped checkpoints, and the driver's heap stays small."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only (null text: empty); other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from one narrow aggregate."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def blocks_for(size: int, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` hold ``size`` bytes."""
    return max(1, math.ceil(size / block_bytes))


def tidy() -> None:
    """Give memory back to the system: a worker that waits for its next task should hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


#: Groups of fewer bytes leave too little behind to be worth collecting.
LARGE = 1 << 20


def tidied(f: Callable) -> Callable:
    """A function of one group of rows that leaves no memory behind."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            if table.nbytes >= LARGE:
                tidy()

    return run


def tidied_pair(f: Callable) -> Callable:
    """The same for two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            if left.nbytes + right.nbytes >= LARGE:
                tidy()

    return run


def tidied_batches(f: Callable) -> Callable:
    """The same for the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def runs(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``most`` bytes; a single longer value stands alone."""
    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
