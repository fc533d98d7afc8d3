"""Approximate nearest neighbours by learned partitions of a neighbour graph.

A bounded sample of the vectors (about ``SAMPLE_ROWS``, by a hash) gives a
neighbour graph. Recursive bisection at the median of its second spectral
vector, then exchanges that cut fewer edges, split the graph into parts of
equal size. A small network learns which part a vector belongs to; it places
every vector in its most probable part and routes each query to as many
probable parts as hold ``RECALL_PARTS`` of the true neighbours of some ``TRIALS``
vectors, which one pass over all vectors finds. Candidates are ranked by
their exact inner products in double precision.

A sample of bounded size can tell a bounded number of parts apart. Where a part
is left with more than ``DEEPER`` times ``PART_ROWS`` vectors, a sample of its
own gives it a graph, a partition and a router of its own, learned in a task for
each part: the leaves of both levels grow with the table (up to some 16,000), so a
query meets few groups. Where the vectors have no structure the sample says that
most parts are needed, and most are searched: recall comes before speed.

Only distinct vectors are placed; each keeps the ``k + 1`` smallest ids that
share it, which is all that ties and a query's own row can need, so thousands of
copies are one candidate. Scores are sums in numpy's pairwise order, and ties are
judged on them. A part, and the queries sent to it, is dealt out in groups of
bounded size by a hash.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components, and candidates without an id, take no part; with
few candidates all are returned; rows that share an id are queries and candidates
each, and a query leaves out its own row only; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare

SAMPLE_ROWS = 6000
NEIGHBOURS = 10
#: Distinct vectors a part holds on average, in at least and at most so many parts.
PART_ROWS = 1500
LEAST_PARTS, MOST_PARTS = 4, 256
#: A part with so many times PART_ROWS vectors is parted again.
DEEPER = 2
#: Shares of the true neighbours of trial vectors that the parts, and all leaves searched, hold.
RECALL_PARTS, RECALL = 0.98, 0.95
TRIALS = 256
GROUP_ROWS = 4096
HIDDEN = 128


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(v: pa.Array, rows: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _neighbours(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), k), "i4")
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(rows: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for half of ``rows``, so that few edges of the neighbour graph are cut."""
    place = np.full(near.shape[0], -1, "i4")
    place[rows] = np.arange(len(rows))
    a = np.repeat(np.arange(len(rows)), near.shape[1])
    b = place[near[rows]].ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(rows)) + 1e-9
    v = rng.standard_normal(len(rows))
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(a, weights=v[b], minlength=len(rows)) / degree
        v /= np.abs(v).max() + 1e-30
    half = len(rows) // 2
    side = np.zeros(len(rows), bool)
    side[np.argsort(v, kind="stable")[half:]] = True
    for _ in range(8):
        s = np.where(side, 1.0, -1.0)
        gain = -s * np.bincount(a, weights=s[b], minlength=len(rows))
        up, down = np.flatnonzero(~side), np.flatnonzero(side)
        up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
        n = min(len(up), len(down))
        better = int((gain[up[:n]] + gain[down[:n]] > 0).sum()) // 2
        if not better:
            break
        side[up[:better]], side[down[:better]] = True, False
    return side


def partition(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced parts (a power of two) of the neighbour graph."""
    label = np.zeros(near.shape[0], "i4")
    n = 1
    while n < parts:
        for p in range(n):
            rows = np.flatnonzero(label == p)
            if len(rows) > 1:
                label[rows[_bisect(rows, near, rng)]] = p + n
        n *= 2
    return label


class Router:
    """A network of one hidden layer: how probable each part is for a vector."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def outputs(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x.astype("f4") @ w1 + b1, 0) @ w2 + b2

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator, epochs: int = 40, batch: int = 256) -> Router:
        d = x.shape[1]
        x = x.astype("f4")
        w = [rng.standard_normal((d, HIDDEN)).astype("f4") * (2 / d) ** 0.5, np.zeros(HIDDEN, "f4"), rng.standard_normal((HIDDEN, parts)).astype("f4") * (1 / HIDDEN) ** 0.5, np.zeros(parts, "f4")]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                h = np.maximum(x[i] @ w[0] + w[1], 0)
                o = h @ w[2] + w[3]
                o = np.exp(o - o.max(1, keepdims=True))
                o /= o.sum(1, keepdims=True)
                o[np.arange(len(i)), label[i]] -= 1
                o /= len(i)
                back = (o @ w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[i].T @ back, back.sum(0), h.T @ o, o.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return cls(w)


def learn(sample: np.ndarray, rows: int) -> Router:
    """A router to the parts that ``rows`` vectors get."""
    rng = np.random.default_rng(7)
    wanted = min(MOST_PARTS, max(LEAST_PARTS, rows // PART_ROWS), max(1, len(sample) // 32))
    parts = 1 << int(np.log2(wanted))
    scaled = _scaled(sample)
    if parts == 1 or len(sample) < 64:
        return Router([np.zeros((sample.shape[1], HIDDEN), "f4"), np.zeros(HIDDEN, "f4"), np.zeros((HIDDEN, 1), "f4"), np.zeros(1, "f4")])
    label = partition(_neighbours(scaled, min(NEIGHBOURS, len(sample) - 1)), parts, rng)
    return Router.fit(scaled, label, parts, rng)


def trials(distinct: DataFrame, total: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About ``TRIALS`` vectors, the k nearest vectors of each among all, and whose neighbour each is: one pass that keeps a short list a partition."""
    asked = distinct.where(F.pmod(F.xxhash64("v", F.lit(17)), F.lit(1 << 30)) < int(min(1.0, TRIALS / max(1, total)) * (1 << 30))).select("rep", "v").collect()
    if not asked:
        return np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, int)
    shared = distinct.sparkSession.sparkContext.broadcast((np.array([r["rep"] for r in asked]), np.array([list(r["v"]) for r in asked])))

    def short(batches):
        reps, q = shared.value
        best, near = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0, q.shape[1]))
        for batch in batches:
            x = _matrix(batch.column("v"), batch.num_rows)
            s = q @ x.T
            s[reps[:, None] == batch.column("rep").to_numpy()[None]] = -np.inf
            at = np.argsort(-s, axis=1)[:, :k]
            best, near = np.concatenate([best, np.take_along_axis(s, at, 1)], 1), np.concatenate([near, x[at]], 1)
            keep = np.argsort(-best, axis=1)[:, :k]
            best, near = np.take_along_axis(best, keep, 1), np.take_along_axis(near, keep[:, :, None], 1)
        rows = [[{"score": float(e), "v": v} for e, v in zip(es, vs, strict=True) if e > -np.inf] for es, vs in zip(best, near, strict=True)]
        kind = pa.list_(pa.struct([("score", pa.float64()), ("v", pa.list_(pa.float64()))]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q)), pa.int32()), pa.array(rows, kind)], names=["q", "best"])

    longest = F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, k).alias("best")
    lists = distinct.select("rep", "v").mapInArrow(short, "q int, best array<struct<score:double,v:array<double>>>").withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
    found = lists.groupBy("q", "some").agg(longest).groupBy("q").agg(longest).collect()
    whose = [r["q"] for r in found for _ in r["best"]]
    near = [list(b["v"]) for r in found for b in r["best"]]
    q = shared.value[1]
    return q, np.array(near).reshape(-1, q.shape[1]), np.array(whose, int)


def _ranks(router: Router, asked: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The place that a neighbour's own part has in the order in which its query visits parts."""
    own = router.outputs(_scaled(near)).argmax(1)
    out = router.outputs(_scaled(asked))
    order = np.argsort(-out, axis=1, kind="stable")
    return (order == own[:, None]).argmax(1)


def _enough(ranks: np.ndarray, parts: int, wanted: float) -> int:
    """So many parts hold the wanted share of all neighbours."""
    return next((n for n in range(1, parts) if len(ranks) and (ranks < n).mean() >= wanted), parts)


def deeper(routed: DataFrame) -> dict[int, list[np.ndarray]]:
    """Routers for the parts that are too large; each is learned in one task from a bounded sample."""
    own = routed.select("v", F.get("parts", F.lit(0)).alias("part"))
    # at most MOST_PARTS rows
    large = {r["part"]: r["count"] for r in own.groupBy("part").count().collect() if r["count"] > DEEPER * PART_ROWS}
    if not large:
        return {}
    counts = routed.sparkSession.createDataFrame(list(large.items()), "part int, n bigint")
    some = own.join(F.broadcast(counts), "part").where(F.pmod(F.xxhash64("v", F.lit(13)), F.lit(1 << 30)) < F.lit(float(SAMPLE_ROWS) * (1 << 30)) / F.col("n"))

    def train(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("v").combine_chunks(), group.num_rows)
        x = x[np.lexsort(x.T)]
        router = learn(x, group.column("n")[0].as_py())
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "weights": pa.array([[w.astype("f4").ravel().tolist() for w in router.weights]], pa.list_(pa.list_(pa.float32())))})

    found = {}
    for r in some.groupBy("part").applyInArrow(train, "part int, weights array<array<float>>").collect():
        w1, b1, w2, b2 = (np.array(w, "f4") for w in r["weights"])
        found[r["part"]] = [w1.reshape(-1, len(b1)), b1, w2.reshape(len(b1), -1), b2]
    return found


def leaves(routed: DataFrame, models, every: bool) -> DataFrame:
    """``rep, ids, times, v, leaves``: each vector's own leaf, or (``every``) all that it is sent to as a query."""

    def down(batches):
        below, probes = models.value
        for batch in batches:
            rows = batch.num_rows
            x = _scaled(_matrix(batch.column("v"), rows))
            parts = batch.column("parts").to_pylist()
            pairs = np.array([(i, p) for i, ps in enumerate(parts) for p in (ps if every else ps[:1])], "i4").reshape(-1, 2)
            out: list[list[int]] = [[] for _ in range(rows)]
            for p in np.unique(pairs[:, 1]).tolist():
                at = pairs[pairs[:, 1] == p, 0]
                if p not in below:
                    mine = np.zeros((len(at), 1), int)
                else:
                    mine = np.argsort(-Router(below[p]).outputs(x[at]), axis=1, kind="stable")[:, : probes if every else 1]
                for i, found in zip(at.tolist(), (p * MOST_PARTS + mine).tolist(), strict=True):
                    out[i] += found
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "ids", "times", "v")), pa.array(out, pa.list_(pa.int32()))], names=["rep", "ids", "times", "v", "leaves"])

    schema = ", ".join(f"{c} {routed.schema[c].dataType.simpleString()}" for c in ("rep", "ids", "times", "v"))
    return routed.mapInArrow(down, schema + ", leaves array<int>")


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.size(v) > 0
    rows = rows.select("vec_id", v.alias("v")).where(good & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    first = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (first["n"] if first else 0))


def search(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``is_query`` holds."""
    spark = prepare(rows.sparkSession)
    good = usable(rows)
    # -0.0 and 0.0 are one number: equal vectors must be one key
    good = good.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).checkpoint()
    # rows that share id and vector are one entry with their number
    repeated = good.where("vec_id is not null").groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k + 1)).cast("int").alias("m"))
    ranked = repeated.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id")))
    entries = ranked.where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "m"))).alias("e"))
    # a vector's number: the same id may have several vectors
    distinct = entries.select("v", F.col("e.vec_id").alias("ids"), F.col("e.m").alias("times"), F.monotonically_increasing_id().alias("rep")).checkpoint()
    total = distinct.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    taken = distinct.where(F.pmod(F.xxhash64("v", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").collect()
    sample = np.array(sorted(list(r["v"]) for r in taken)) if taken else np.zeros((0, 1))
    router = learn(sample, total)
    parts = len(router.weights[3])
    asked, near, whose = trials(distinct, total, k) if parts > 1 else (np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, int))
    ranks = _ranks(router, asked[whose], near) if len(whose) else np.zeros(0, int)
    shared = spark.sparkContext.broadcast((router.weights, _enough(ranks, parts, RECALL_PARTS)))

    def route(batches):
        weights, n = shared.value
        own = Router(weights)
        for batch in batches:
            v = batch.column("v")
            out = own.outputs(_scaled(_matrix(v, batch.num_rows)))
            order = np.argsort(-out, axis=1, kind="stable")[:, :n].astype("i4")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("ids"), batch.column("times"), v, pa.array(list(order), pa.list_(pa.int32()))], names=["rep", "ids", "times", "v", "parts"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    routed = distinct.select("rep", "ids", "times", "v").mapInArrow(route, f"rep bigint, ids array<{kind}>, times array<int>, v array<double>, parts array<int>").checkpoint()
    # at most MOST_PARTS routers of HIDDEN units each
    below = deeper(routed)
    # a neighbour in a part that is not parted again, or is not visited at all, has place 0 or none
    lost, inner = ranks >= shared.value[1], np.zeros(len(ranks), int)
    home = router.outputs(_scaled(near)).argmax(1) if len(whose) else np.zeros(0, int)
    for p, weights in below.items():
        inner[home == p] = _ranks(Router(weights), asked[whose][home == p], near[home == p]) if (home == p).any() else 0
    most = max((len(w[3]) for w in below.values()), default=1)
    models = spark.sparkContext.broadcast((below, _enough(np.where(lost, most, inner), most, RECALL)))
    index = leaves(routed, models, False).select("rep", "ids", "times", "v", F.get("leaves", F.lit(0)).alias("part"))
    asking = good.where(is_query).select(F.col("vec_id").alias("query_id"), "v").join(distinct.select("v", "rep"), "v").select("query_id", "rep")
    reps = asking.select("rep").distinct()
    queries = leaves(routed.join(reps, "rep", "left_semi"), models, True).select(F.col("rep").alias("q_rep"), F.col("v").alias("q_v"), F.explode("leaves").alias("part"))
    if below:
        index, queries = index.checkpoint(), queries.checkpoint()
    # the numbers of a leaf's groups: one row for each leaf
    groups = {name: {r["part"]: -(-r["count"] // GROUP_ROWS) for r in df.groupBy("part").count().collect()} for name, df in (("index", index), ("queries", queries))}
    sizes = spark.createDataFrame([(p, n, groups["queries"].get(p, 0)) for p, n in groups["index"].items()], "part int, i_groups int, q_groups int")

    def dealt(df: DataFrame, rep: str, own: str, other: str, name: str, across: str) -> DataFrame:
        """Each row in its own group and in all groups of the other side."""
        with_sizes = df.join(F.broadcast(sizes), "part").where(F.col(other) > 0)
        mine = F.pmod(F.xxhash64(rep), F.col(own)).cast("int")
        return with_sizes.withColumn(name, mine).withColumn(across, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    left = dealt(index, "rep", "i_groups", "q_groups", "i", "q").select("part", "i", "q", "rep", "ids", "times", "v")
    right = dealt(queries, "q_rep", "q_groups", "i_groups", "q", "i").select(F.col("part").alias("q_part"), F.col("i").alias("q_i"), F.col("q").alias("q_q"), "q_rep", "q_v")

    def compare(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        """For each query its k + 1 best of these rows, as one row; own: the row has the query's vector."""
        reps, best = [], []
        if vectors.num_rows and asked.num_rows:
            matrix = lambda t, v: _matrix(t.column(v).combine_chunks(), t.num_rows)
            x, ids, times = matrix(vectors, "v"), vectors.column("ids").to_pylist(), vectors.column("times").to_pylist()
            numbers = vectors.column("rep").to_pylist()
            length = np.linalg.norm(x, axis=1).max()
            most = min(k + 1, len(ids))
            for a in range(0, asked.num_rows, 256):
                part = asked.slice(a, 256)
                q = matrix(part, "q_v")
                s = q @ x.T
                # a sum of products in another order may differ by so much
                slack = 4 * x.shape[1] * np.finfo("f8").eps * length * np.linalg.norm(q, axis=1)
                limits = -np.partition(-s, most - 1, axis=1)[:, most - 1] - slack
                for r, rep in enumerate(part.column("q_rep").to_pylist()):
                    at = np.flatnonzero(s[r] >= limits[r])  # with all that tie with the last
                    exact = (x[at] * q[r]).sum(1)
                    told = [(-e, i, numbers[j] == rep, m) for j, e in zip(at.tolist(), exact.tolist(), strict=True) for i, m in zip(ids[j], times[j], strict=True)]
                    rows = [{"away": d, "vec_id": i, "own": own} for d, i, own, m in heapq.nsmallest(k + 1, told) for _ in range(m)]
                    reps.append(rep)
                    best.append(rows[: k + 1])
        kind = pa.struct([("away", pa.float64()), ("vec_id", pa.int64()), ("own", pa.bool_())])
        return pa.table({"rep": pa.array(reps, pa.int64()), "best": pa.array(best, pa.list_(kind))})

    near = left.groupBy("part", "i", "q").cogroup(right.groupBy("q_part", "q_i", "q_q")).applyInArrow(compare, "rep bigint, best array<struct<away:double,vec_id:bigint,own:boolean>>")
    # a short list from each group of each part that the query was sent to; the query's own row goes, k others stay
    lists = near.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    own = F.array_position(F.transform("best", lambda b: b["own"] & (b["vec_id"] == F.col("query_id"))), True)
    pairs = asking.join(lists, "rep").select("query_id", own.alias("own"), F.posexplode("best").alias("pos", "b")).where(F.col("pos") + 1 != F.col("own"))
    rank = F.col("pos") + F.when((F.col("own") > 0) & (F.col("pos") + 1 > F.col("own")), 0).otherwise(1)
    return pairs.select("query_id", rank.cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.away")).alias("score")).where(F.col("rank") <= k)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector of ``embeddings`` whose id is divisible by 20, among all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
