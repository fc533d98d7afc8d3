"""Numbers and sums along a global order, without one task that sees all rows.

Rows are dealt into ranges of the order and written; a first pass adds up each range,
and each row then has what its own range gives it and the sum of the ranges before.
Only the ranges' sums, a number for each partition, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import saved


def _ranges(rows: DataFrame, order: str, parts: int | None) -> DataFrame:
    """``rows`` with ``_part``, which grows with ``order``; equal values share one. A null order comes first."""
    dealt = rows.repartitionByRange(parts, order) if parts else rows.repartitionByRange(order)
    return saved(dealt.withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, order: str, values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``rows`` (one for each value of ``order``) with the sums of ``values`` over all rows up to each, by the names they have there."""
    own = _ranges(rows.withColumns({f"_v{i}": v for i, v in enumerate(values.values())}), order, parts)
    sums = own.groupBy("_part").agg(*(F.sum(f"_v{i}").alias(f"_v{i}") for i in range(len(values)))).collect()
    w = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = {}
    for i, name in enumerate(values):
        before, total = {}, None
        for r in sorted(sums, key=lambda r: r["_part"]):
            if total is not None:
                before[r["_part"]] = total
            total = r[f"_v{i}"] if total is None else total + (r[f"_v{i}"] or 0)
        kind = own.schema[f"_v{i}"].dataType
        offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("_part")] if before else F.lit(None)
        out[name] = F.sum(f"_v{i}").over(w) + F.coalesce(offset, F.lit(0).cast(kind))
    return own.withColumns(out).drop("_part", *(f"_v{i}" for i in range(len(values))))


def numbered(rows: DataFrame, order: str, name: str = "n", parts: int | None = None) -> DataFrame:
    """``rows`` (one for each value of ``order``) with their places in it, from 1."""
    return running(rows, order, {name: F.lit(1).cast("bigint")}, parts)
