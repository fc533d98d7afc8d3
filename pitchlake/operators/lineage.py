"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for files that a job writes and reads again."""
    _set(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there.

    The folder is the one named in ``spark.checkpoint.dir``, which driver and
    executors share; only a local session without it, as in tests, gets its own.
    ``checkpoint()`` keeps what the optimizer has inferred about the rows, and from
    round to round of a loop that doubles on the driver; a file keeps rows only, and
    they are computed once.
    """
    path = folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _set(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "pitchlake-checkpoints"))
