"""Fewer dimensions for pruned vectors: principal components from distributed moments, applied as a column expression."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Components:
    """Mean and orthonormal directions (k x width), by falling variance; the largest entry of each is positive."""

    mean: np.ndarray
    base: np.ndarray
    variance: np.ndarray


def usable(vector: Column) -> Column:
    """Has the vector components, all of them finite?"""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def principal(rows: DataFrame, vector: str, k: int) -> Components | None:
    """The k directions of most variance of ``vector``, over all rows that have the width of most; none without rows.

    Each partition adds up its products, a line of the matrix is one group, and
    the driver gets a line for each component (width squared numbers). k is at
    most the width.
    """
    good = rows.select(F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    first = good.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if first is None:
        return None
    width = first["width"]
    good = good.where(F.size("v") == width)
    # sums around any one vector lose less than around zero
    centre = np.array(good.first()["v"])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            if len(batch):
                x = np.c_[np.ones(len(batch)), np.stack(batch["v"].to_list()) - centre]
                total += x.T @ x
        yield pd.DataFrame({"line": range(width + 1), "v": total.tolist()})

    def added(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": [k[0]], "v": [np.sum(np.stack(g["v"].to_list()), 0).tolist()]})

    lines = good.mapInPandas(moments, "line int, v array<double>").groupBy("line").applyInPandas(added, "line int, v array<double>").collect()
    m = np.array([r["v"] for r in sorted(lines, key=lambda r: r["line"])])
    n, s = m[0, 0], m[0, 1:]
    values, base = np.linalg.eigh((m[1:, 1:] - np.outer(s, s) / n) / max(n - 1, 1))
    top = np.argsort(-values, kind="stable")[:k]
    base = base[:, top].T
    base *= np.where(base[np.arange(len(base)), np.abs(base).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Components(centre + s / n, base, np.maximum(values[top], 0.0))


def _matrix(m: np.ndarray) -> Column:
    return F.from_json(F.lit(json.dumps(m.tolist())), "array<array<double>>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def projected(vector: Column, c: Components) -> Column:
    """The vector's places along the components; null for one of another width or with components that are no finite numbers."""
    v = vector.cast("array<double>")
    centred = F.zip_with(v, F.get(_matrix(c.mean[None]), F.lit(0)), lambda x, m: x - m)
    low = F.get(F.transform(F.array(centred), lambda x: F.transform(_matrix(c.base), lambda b: _dot(x, b))), F.lit(0))
    return F.when(usable(v) & (F.size(v) == len(c.mean)), low)


def restored(low: Column, c: Components) -> Column:
    """The vector that a projection stands for."""
    back = lambda x: F.transform(_matrix(c.base.T), lambda b: _dot(x, b))
    return F.zip_with(F.get(F.transform(F.array(low), back), F.lit(0)), F.get(_matrix(c.mean[None]), F.lit(0)), lambda x, m: x + m)


def squared_error(vector: Column, low: Column, c: Components) -> Column:
    """How far the restored vector is from the vector, squared."""
    return F.aggregate(F.zip_with(vector.cast("array<double>"), restored(low, c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
