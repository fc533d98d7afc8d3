"""Connected components of an undirected graph: forests of partitions, contracted until they agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import U, mixed
from .common import swept

#: Links of a later round that one task takes: few are left, and a forest of all of them ends the rounds.
TASK_LINKS = 1 << 17


def roots(a: np.ndarray, b: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the root of each: its component's node that comes first in an order by salted hashes."""
    nodes = np.unique(np.concatenate([a, b]))
    nodes = nodes[np.argsort(mixed(nodes.view("u8"), U(salt)), kind="stable")]
    place = np.argsort(nodes)
    a, b = (place[np.searchsorted(nodes, x, sorter=place)] for x in (a, b))
    label = np.arange(len(nodes))
    while True:
        near = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], near)
            np.minimum.at(label, end, near)
        label = label[label]
        if np.array_equal(label, before):
            return nodes, nodes[label]


def _forest(salt: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)) for batch in batches]
        if edges:
            nodes, found = roots(*(np.concatenate(x) for x in zip(*edges, strict=True)), salt)
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(found[i : i + (1 << 16)])], names=["node", "root"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (one node of its component) of each end of ``edges`` (``a``, ``b``: long).

    Each partition finds the forest of its own edges, so that a node that all
    edges share is one row of each partition. A node that partitions give
    different roots connects those roots: these are the edges of the next round.
    Roots come first by a hash salted anew, so that the nodes of any graph that is
    left become fewer by a constant share, long chains too. Later rounds take
    ``TASK_LINKS`` links a task. Rounds are checkpointed; nothing but the number of
    links left reaches the driver.
    """
    rounds: list[DataFrame] = []
    edges = edges.where("a <> b").select("a", "b")
    while True:
        salt = len(rounds) + 1
        first: Column = F.array_min(F.transform("roots", lambda r: F.struct(F.xxhash64(r, F.lit(salt)).alias("h"), r.alias("r"))))["r"]
        forest = edges.mapInArrow(_forest(salt), "node long, root long").groupBy("node").agg(F.collect_set("root").alias("roots"))
        rounds.append(forest.select("node", "roots", first.alias("label")).checkpoint())
        edges = rounds[-1].where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("label").alias("b")).where("a <> b")
        left = edges.count()
        if not left:
            break
        edges = edges.coalesce(-(-left // TASK_LINKS))
        swept(edges.sparkSession)
    labels = rounds[-1].select("node", "label")
    for earlier in reversed(rounds[:-1]):
        beyond = labels.select(F.col("node").alias("through"), F.col("label").alias("beyond"))
        labels = earlier.select("node", F.col("label").alias("through")).join(beyond, "through", "left").select("node", F.coalesce("beyond", "through").alias("label"))
    return labels.checkpoint() if len(rounds) > 1 else labels
