"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's lines are its paragraphs; their distinct 64-bit digests form a set.
Each digest goes into one cell of each third of a sketch; a cell holds a count,
the xor of its digests and the xor of their checks. Subtracting two sketches
leaves the digests of one text only; peeling takes out the digest of every cell
that holds just one, until nothing is left. If cells remain, both sketches are
built again, four times as large, until one is large enough for all digests of
both sets, and twice more; only where even that fails, by chance, the sets
themselves are compared, so every likeness is exact. Likeness is common over all
distinct paragraphs (1 for equal sets).

The next document, by descending id, comes from a window over ranges of ids (and,
within an id, of its texts' hashes) cut at quantiles of a bounded sample; the
first row of each range also goes to the range before it. One shuffle moves each
text once. Rows that share id and text share a range.

Edge cases: null text counts as empty, which is one empty paragraph; a null id
comes after all others; equal ids follow in the order of their texts' hashes;
the last document's next is the first, a single document's is itself; an empty
table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks_for, texts, total_bytes

RANGE_BYTES = 1 << 20
#: More input makes larger ranges (their sort spills), never a longer list on the driver.
MOST_RANGES = 100_000
#: Places sampled for each bound; the driver gets so many pairs of numbers for each range.
SAMPLED = 16
#: A sketch of side s has 3 s^2 cells. The first has 48, each next one twice the side.
SIDE = 4
_CHECK = 7919
_LOWEST = -(2**63)


def paragraphs(text: Column | str) -> Column:
    """Digests of a text's distinct lines."""
    return F.array_distinct(F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p)))


def _entry(key: Column, sign: Column) -> Column:
    """A digest with its check, its three hashes and the sign it counts with."""
    hashes = (F.xxhash64(key, F.lit(k)).alias(f"h{k}") for k in range(3))
    return F.struct(key.alias("key"), F.xxhash64(key, F.lit(_CHECK)).alias("check"), *hashes, sign.alias("n"))


def _entries(digests: Column) -> Column:
    return F.transform(digests, lambda d: _entry(d, F.lit(1)))


def _zero() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("check"))


def sketch(entries: Column, side: Column | int) -> Column:
    """The cells of a set of entries: an array of count, key and check.

    A third of the cells is dealt in as many strips as a strip has cells; an
    entry passes the strips and then the cells of one, not all cells.
    """
    side = F.lit(side) if isinstance(side, int) else side

    def added(c: Column, e: Column) -> Column:
        return F.struct((c["n"] + e["n"]).alias("n"), c["key"].bitwiseXOR(e["key"]).alias("key"), c["check"].bitwiseXOR(e["check"]).alias("check"))

    def strip_of(placed: Column, g: Column) -> Column:
        mine = F.filter(placed, lambda e: F.floor(e["at"] / side) == g)
        return F.aggregate(mine, F.array_repeat(_zero(), side), lambda cells, e: F.transform(cells, lambda c, j: F.when(e["at"] % side != j, c).otherwise(added(c, e))))

    def third(k: Column) -> Column:
        at = lambda e: F.pmod(F.when(k == 0, e["h0"]).when(k == 1, e["h1"]).otherwise(e["h2"]), (side * side).cast("bigint")).cast("int")
        placed = F.transform(entries, lambda e: F.struct(at(e).alias("at"), e["key"].alias("key"), e["check"].alias("check"), e["n"].alias("n")))
        # an array of one names the placed entries, so they are placed once
        return F.flatten(F.flatten(F.transform(F.array(placed), lambda all_: F.transform(F.sequence(F.lit(0), side - 1), lambda g: strip_of(all_, g)))))

    return F.flatten(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), third))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check"))
    )


def peel(cells: Column, side: Column | int, rounds: Column | int) -> Column:
    """How many digests the difference of two sketches holds; null if it can't be taken apart.

    One step finds the cells that hold one digest, the next takes these digests out
    of all their cells; when none is found, the steps that are left do nothing.
    """

    def step(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (F.xxhash64(c["key"], F.lit(_CHECK)) == c["check"]))
        pure = F.transform(F.array_distinct(F.transform(alone, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n")))), lambda c: _entry(c["key"], c["n"]))
        looked = F.struct(state["cells"].alias("cells"), pure.alias("out"), state["found"].alias("found"), F.lit(True).alias("on"))
        left = F.struct(subtract(state["cells"], sketch(state["out"], side)).alias("cells"), F.array().cast(_OUT).alias("out"), (state["found"] + F.size(state["out"])).alias("found"), F.lit(True).alias("on"))
        stuck = F.struct(state["cells"].alias("cells"), state["out"].alias("out"), state["found"].alias("found"), F.lit(False).alias("on"))
        next_ = F.when(F.size(state["out"]) > 0, left).otherwise(looked)
        # a look that finds none ends the peeling: the state after it has no digest to take out
        ends = F.transform(F.array(next_), lambda s: F.when((F.size(s["out"]) == 0) & (F.size(state["out"]) == 0), stuck).otherwise(s))
        return F.when(state["on"], F.get(ends, F.lit(0))).otherwise(stuck)

    first = F.struct(cells.alias("cells"), F.array().cast(_OUT).alias("out"), F.lit(0).alias("found"), F.lit(True).alias("on"))
    empty = lambda s: ~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))
    rounds = F.lit(rounds) if isinstance(rounds, int) else rounds
    return F.aggregate(F.sequence(F.lit(1), 2 * rounds), first, step, lambda s: F.when(empty(s) & (F.size(s["out"]) == 0), s["found"]))


_OUT = "array<struct<key:bigint,check:bigint,h0:bigint,h1:bigint,h2:bigint,n:int>>"


def likeness(pair: Column) -> Column:
    """Common over all digests of two sets. pair: entries ``a`` and ``b`` and their sketches of side SIDE, ``print_a`` and ``print_b``."""
    n_a, n_b = F.size(pair["a"]), F.size(pair["b"])
    # the first power of two whose sketch has a cell and a half for each digest of both sets, and two more
    most = F.greatest(F.ceil(F.log2(F.sqrt((n_a + n_b) / 2.0 + 1.0))), F.lit(2)).cast("int") + 2

    def attempt(found: Column, power: Column) -> Column:
        side = F.pow(F.lit(2.0), power).cast("int")
        one, two = (F.when(power == 2, pair[f"print_{x}"]).otherwise(sketch(pair[x], side)) for x in ("a", "b"))
        # the sizes of the sets alone may tell that a sketch is too small
        able = F.abs(n_a - n_b) <= 3 * side * side
        return F.when(found >= 0, found).when(able, F.coalesce(peel(subtract(one, two), side, 4 + 2 * power), F.lit(-1))).otherwise(-1)

    sketched = F.aggregate(F.sequence(F.lit(2), most), F.lit(-1), attempt)
    keys = lambda x: F.transform(pair[x], lambda e: e["key"])
    exact = F.size(F.array_except(keys("a"), keys("b"))) + F.size(F.array_except(keys("b"), keys("a")))
    differing = F.get(F.transform(F.array(sketched), lambda d: F.when(d >= 0, d).otherwise(exact)), F.lit(0))
    shared = lambda d: ((n_a + n_b - d) / 2) / ((n_a + n_b - d) / 2 + d)
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise(F.get(F.transform(F.array(differing), shared), F.lit(0)))


def written(cells: Column) -> Column:
    """A sketch as text: count, key and check of each cell in hexadecimal."""
    return F.array_join(
        F.transform(cells, lambda c: F.when(c["n"] == 0, F.lit("-")).otherwise(F.lower(F.concat_ws(":", F.hex(c["n"].cast("bigint")), F.hex(c["key"]), F.hex(c["check"]))))), ","
    )


def bounds_of(source: DataFrame, n: int) -> list[dict[str, int]]:
    """At most n - 1 bounds that cut ``place`` (two numbers) into ranges, from about SAMPLED different places for each, chosen by hash."""
    if n < 2:
        return []
    rows = source.count()
    share = int(min(1.0, SAMPLED * n / max(rows, 1)) * (1 << 30))
    found = source.where(F.pmod(F.xxhash64("place", F.lit(5)), F.lit(1 << 30)) < share).select("place.*").distinct().toPandas()
    found = found.sort_values(["place", "back"], ignore_index=True)
    at = sorted({i * len(found) // n for i in range(1, n)} - {0})
    return [{"place": int(p), "back": int(b)} for p, b in found.iloc[at].itertuples(index=False)]


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id``, ``text``, ``paragraphs`` and those of the next document (``next_text``, ``next_paragraphs``)."""
    source = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("place"))
    size = total_bytes(source)
    n = min(MOST_RANGES, blocks_for(size, range_bytes))
    # ascending places are descending ids' order the other way round: the tie counts down
    source = source.withColumn("tie", F.xxhash64("text")).withColumn("place", F.struct("place", F.bitwise_not("tie").alias("back")))
    cuts = bounds_of(source, n)
    step = max(1, int(len(cuts) ** 0.5))
    spark = docs.sparkSession
    listed = lambda x: F.from_json(F.lit(json.dumps(x)), "array<struct<place:bigint,back:bigint>>")
    bounds = spark.range(1).select(listed(cuts).alias("fine"), listed(cuts[step - 1 :: step]).alias("coarse"))
    # a place's range: how many bounds are below it, by coarse steps first
    over = F.size(F.filter("coarse", lambda c: c < F.col("place"))) * step
    number = over + F.size(F.filter(F.slice("fine", over + 1, F.lit(step)), lambda c: c < F.col("place")))
    ranged = source.crossJoin(F.broadcast(bounds)).withColumn("range", number.cast("int")).drop("fine", "coarse")
    order = [F.col("place").desc(), F.col("text")]
    # one row for each range reaches the driver: its number and largest place
    tops = sorted((r["range"], tuple(r["place"])) for r in ranged.groupBy("range").agg(F.max("place").alias("place")).collect())
    above = {place: tops[(i + 1) % len(tops)][0] for i, (_, place) in enumerate(tops)}
    target = spark.createDataFrame(list(above.items()), "place struct<place:bigint,back:bigint>, target int")
    heads = ranged.join(F.broadcast(target), "place").withColumn("first", F.row_number().over(W.partitionBy("place").orderBy("text"))).where("first = 1")
    both = ranged.withColumn("extra", F.lit(0)).unionByName(heads.select("doc_id", "text", "place", F.col("target").alias("range"), "tie", F.lit(1).alias("extra")))
    window = W.partitionBy("range").orderBy("extra", *order)
    led = both.withColumn("paragraphs", paragraphs("text")).withColumns({"next_text": F.lead("text").over(window), "next_paragraphs": F.lead("paragraphs").over(window)})
    return led.where("extra = 0").select("doc_id", "text", "paragraphs", "next_text", "next_paragraphs")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Prints of each text, of its edited text, and their likenesses.

    The edited text has its last half (rounded down) replaced by as many code
    points from the start of the next document, or all that it has.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_paragraphs", paragraphs("edited"))
    sets = F.transform(F.array("paragraphs", "edited_paragraphs", "next_paragraphs"), _entries)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sets.alias("sets"))
    rows = rows.select("*", F.transform("sets", lambda s: sketch(s, SIDE)).alias("prints"))
    pair = lambda i: F.struct(F.get("sets", F.lit(0)).alias("a"), F.get("sets", F.lit(i)).alias("b"), F.get("prints", F.lit(0)).alias("print_a"), F.get("prints", F.lit(i)).alias("print_b"))
    told = rows.select("doc_id", "n_chars", "edited_sha256", F.transform("prints", written).alias("prints"), F.transform(F.array(pair(1), pair(2)), likeness).alias("near"))
    get = lambda c, i: F.get(c, F.lit(i))
    return told.select(
        "doc_id", "n_chars", "edited_sha256", get("prints", 0).alias("fingerprint"), get("prints", 1).alias("edited_fingerprint"), get("near", 0).alias("near_edited"), get("near", 1).alias("near_next")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text."""
    return fingerprints(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
