"""Self-join of documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

The join is exact. Copies of one text are one class from the start. Shingles
are ordered by how many classes hold them, rarest first (counts over the whole
input, see ``blocks``); two sets that are similar enough share a shingle among
their first n - ceil(t n) + 1, and one that a single class holds is shared by
none, so most classes have nothing to look for.

The others are partitioned into groups of similar sets: those with the same
least hash among their shared shingles meet, in parts of bounded size, and link
to a leader when similar enough. Linked sets form groups. What is left are
links between groups: the token-group matrix holds, for each part of at most
``GROUP_ROWS`` sets of a group, the union of their shingles. A set that shares
one of its first shingles with another group is compared with the union; only
if the overlap could suffice is the part opened and the set compared with its
members. All links together give the components. Sets that a group already
connects are never compared with each other.

Edge cases: null and empty texts, or texts without words, have no shingles and
are linked with nothing, each its own component; texts of fewer words than a
shingle have their whole sequence as one; repeated rows are copies; a null id
never names a component (a component of null ids only has none). Classes are
told apart by 128-bit digests and numbered, sets compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Plan, U, Words, counted, dealt, in_blocks, mixed
from .common import prepare, swept, texts, tidied, tidied_pair, total_bytes
from .graph import components

SHINGLE, PERCENT = 4, 85
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Keys that meet by chance only make a shingle look more frequent; so few bits do.
SPARE_BITS = 7
GROUP_ROWS = 256
QUERY_ROWS = 1024
ROUNDS = 2


def shingle_sets(table: pa.Table, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; letters A-Z count as lower case."""
    words = Words.of([t.as_buffer().to_pybytes().lower() for t in table.column("text")])
    grams, counts = words.grams(k)
    ends = np.cumsum(counts).tolist()
    out = []
    for end, n, start, length in zip(ends, counts.tolist(), words.starts.tolist(), words.lengths.tolist(), strict=True):
        if n:
            out.append(np.unique(grams[end - n : end]))
        else:
            whole = np.full(min(length, 1), length, "u8")
            for i in range(length):
                whole = mixed(whole, words.hashes[words.ids[start + i : start + i + 1]])
            out.append(whole)
    return out


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least intersection that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    return overlap(a, b) >= least_overlap(len(a), len(b), percent)


def _ask(k: int):
    def ask(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = shingle_sets(table, k)
        return np.unique(np.concatenate([np.zeros(0, "u8"), *sets]), return_counts=True)

    return ask


def _sketch(k: int, percent: int):
    def finish(table: pa.Table, block: int, totals: np.ndarray) -> pa.Table:
        sets = shingle_sets(table, k)
        flat = np.concatenate([np.zeros(0, "u8"), *sets])
        df = totals[np.searchsorted(np.unique(flat), flat)] if len(flat) else totals
        alone = np.concatenate([[0], np.cumsum(df == 1)])
        entries, marks, grams, single, a = [], [], [], [], 0
        for s in sets:
            b, n = a + len(s), len(s)
            first = n - -(-percent * n // 100) + 1
            found: np.ndarray = s[:0]
            if n and alone[b] - alone[a] < first:
                own = df[a:b]
                head = np.lexsort((s, own))[:first]
                found = s[head][own[head] > 1]
            entries.append(found.view("i8").tolist())
            single.append(int(alone[b] - alone[a]))
            if len(found):
                shared = s[df[a:b] > 1]
                marks.append([int(mixed(shared, U(i)).min().view("i8")) for i in range(ROUNDS)])
                grams.append(s.astype("<u8").tobytes())
            else:
                marks.append([])
                grams.append(None)
            a = b
        return pa.table({"h": table.column("h"), "n": pa.array([len(s) for s in sets], pa.int64()), "alone": pa.array(single, pa.int64()), "entries": pa.array(entries, pa.list_(pa.int64())), "marks": pa.array(marks, pa.list_(pa.int64())), "grams": pa.array(grams, pa.binary())})

    return finish


def _sets(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(g, "<u8") for g in table.column(column).to_pylist()]


def _link_to_leaders(percent: int):
    def link(table: pa.Table) -> pa.Table:
        """Each set to the first leader that is similar; a set that finds none leads on."""
        table = table.sort_by([("lead", "descending"), ("node", "ascending")])
        nodes, sets = table.column("node").to_pylist(), _sets(table, "grams")
        leaders: list[int] = []
        a, b = [], []
        for i, s in enumerate(sets):
            for j in leaders:
                if similar(s, sets[j], percent):
                    a.append(nodes[i])
                    b.append(nodes[j])
                    break
            else:
                leaders.append(i)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _open(percent: int):
    def opened(members: pa.Table, queries: pa.Table) -> pa.Table:
        """Links of queries with a part of a group, whose union must first leave room for one."""
        a, b = [], []
        if members.num_rows and queries.num_rows:
            sets, nodes = _sets(members, "grams"), members.column("node").to_pylist()
            union, least = np.unique(np.concatenate(sets)), min(map(len, sets))
            for node, q in zip(queries.column("q_node").to_pylist(), _sets(queries, "q_grams"), strict=True):
                if overlap(q, union) < least_overlap(len(q), max(least, -(-percent * len(q) // 100)), percent):
                    continue
                for s, other in zip(sets, nodes, strict=True):
                    if similar(q, s, percent):
                        a.append(node)
                        b.append(other)
                        break  # the members of a group are connected already
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return opened


def _parts(count: str, most: int):
    return F.ceil(F.col(count) / most).cast("int")


def _part(node: str, parts: str):
    return F.pmod(F.xxhash64(node, F.lit(3)), F.col(parts)).cast("int")


def _leaders(sketches: DataFrame, i: int, percent: int) -> DataFrame:
    """Links within the sets of the same i-th mark."""
    marked = sketches.select("node", "grams", F.get("marks", F.lit(i)).alias("mark"))
    stats = marked.groupBy("mark").agg(F.count("*").alias("count"), F.min("node").alias("leader")).where("count > 1").withColumn("parts", _parts("count", GROUP_ROWS))
    met = marked.join(stats, "mark")
    members = met.where("node <> leader").select("mark", _part("node", "parts").alias("part"), "node", "grams", F.lit(0).alias("lead"))
    lead = met.where("node = leader").select("mark", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "grams", F.lit(1).alias("lead"))
    return members.unionAll(lead).groupBy("mark", "part").applyInArrow(tidied(_link_to_leaders(percent)), "a long, b long")


def _between(sketches: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different groups."""
    grouped = sketches.select("node", "n", "alone", "entries").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("group"), "n", "alone", "entries")
    # left: how many shingles of a set stand at or after an entry; those that one class holds come first
    entries = grouped.select("node", "group", "n", "alone", F.posexplode("entries").alias("place", "gram")).select("node", "group", "n", (F.col("n") - F.col("alone") - F.col("place")).alias("left"), "gram")
    # the matrix: a row for each shingle and group that has it among its first ones
    matrix = entries.groupBy("gram", "group").agg(F.max("left").alias("most_left"), F.min("n").alias("least_n"), F.count("*").alias("holders")).checkpoint()
    other = matrix.select("gram", F.col("group").alias("q_group"), F.col("most_left").alias("other_left"), F.col("least_n").alias("other_n"), F.col("holders").alias("other_holders"))

    def room(left: str, n: str) -> Column:
        """Are enough shingles left after the first that both may have?"""
        return F.least(left, "other_left") * (100 + percent) >= (F.col(n) + F.greatest("other_n", F.ceil(F.col(n) * percent / 100))) * percent

    # the group with fewer holders of a shingle asks the other
    asks = F.struct("holders", "group") < F.struct(F.col("other_holders").alias("holders"), F.col("q_group").alias("group"))
    asking = matrix.join(other, "gram").where(asks & room("most_left", "least_n")).select("gram", "group", "q_group", "other_left", "other_n")
    pairs = entries.join(asking, ["gram", "group"]).where(room("left", "n")).select(F.col("node").alias("q_node"), "q_group").distinct().checkpoint()
    sizes = grouped.groupBy("group").agg(F.count("*").alias("size"))
    asked = pairs.groupBy("q_group").agg(F.count("*").alias("asked")).join(sizes, F.col("q_group") == F.col("group")).select("q_group", _parts("size", GROUP_ROWS).alias("parts"), _parts("asked", QUERY_ROWS).alias("turns")).checkpoint()
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    queries = pairs.join(asked, "q_group").select("q_node", "q_group", _part("q_node", "turns").alias("q_turn"), every("parts").alias("q_part"))
    queries = queries.join(sketches.select(F.col("node").alias("q_node"), F.col("grams").alias("q_grams")), "q_node")
    members = grouped.select("node", "group").join(asked.withColumnRenamed("q_group", "group"), "group").select("node", "group", _part("node", "parts").alias("part"), every("turns").alias("turn"))
    members = members.join(sketches.select("node", "grams"), "node")
    return members.groupBy("group", "part", "turn").cogroup(queries.groupBy("q_group", "q_part", "q_turn")).applyInArrow(tidied_pair(_open(percent)), "a long, b long")


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and ``h``, a digest of the text, for each row of ``docs`` (``doc_id``, ``text``)."""
    prepare(docs.sparkSession)
    plan = Plan.fit(total_bytes(docs), BLOCK_BYTES, BUCKET_BYTES, SPARE_BITS)
    digested = dealt(docs.withColumn("h", F.unhex(F.md5("text"))), plan)
    keyed = digested.select("doc_id", "h", "block").checkpoint()
    # of a class of equal texts the row of the smallest id stands for all, in the block where that row is
    classes = keyed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min_by("block", F.struct(F.col("doc_id").isNull(), "doc_id", "block")).alias("block"))
    blocked = in_blocks(digested, plan)
    chosen = classes.select(F.col("block").alias("c_block"), F.col("h").alias("c_h"))
    classes = classes.drop("block")
    schema = "h binary, n long, alone long, entries array<bigint>, marks array<bigint>, grams binary"
    # a class's number is unique, and fixed by the checkpoint
    everything = counted(blocked, plan, _ask(k), _sketch(k, percent), schema, chosen).withColumn("node", F.monotonically_increasing_id()).checkpoint()
    swept(docs.sparkSession)
    sketches = everything.where(F.size("entries") > 0).select("node", "n", "alone", "entries", "marks", "grams")
    links = _leaders(sketches, 0, percent)
    for i in range(1, ROUNDS):
        links = links.unionAll(_leaders(sketches, i, percent))
    links = links.checkpoint()
    swept(docs.sparkSession)
    labels = components(links)
    swept(docs.sparkSession)
    more = _between(sketches, labels, percent)
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(more))
    swept(docs.sparkSession)
    placed = classes.join(everything.select("h", "n", "node"), "h").join(labels, "node", "left").select("h", "doc_id", "n", F.coalesce("label", "node").alias("label"))
    named = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    whole = placed.join(named, "label").select("h", F.col("n").alias("n_shingles"), "component_id")
    return keyed.join(whole, "h").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` linked by a Jaccard similarity of 0.85 and more of 4-word shingles."""
    return join(texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "n_shingles", "component_id")
