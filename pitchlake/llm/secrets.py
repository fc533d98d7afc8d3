"""Secret scan in DataFrame functions only: fixed patterns plus character Markov models.

Two first-order Markov models over ASCII characters are trained from labelled
samples: random strings (digests written in three alphabets, and what the fixed
patterns find in a bounded sample of documents) and ordinary identifiers (long
words of the same documents outside such matches). A run of identifier
characters whose mean log-likelihood ratio per transition, random against
ordinary, passes a threshold is a further span of kind ``markov``, unless it
overlaps a span of the fixed patterns.

The sample is about ``SAMPLE_DOCS`` documents, chosen by a hash of the text, and
``SAMPLE_RANDOM`` digests; it bounds training only: every whole text is
scanned. The model is a table of 128 x 128 numbers, one broadcast row.

Edge cases: null and empty texts have no spans; with no documents the models
come from the digests and a few built-in identifiers; repeated rows are scanned
each; positions are code points, end exclusive.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts

# The three patterns, in the order of their kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6

#: Runs that the Markov models judge.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.7
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 4000
IDENTIFIERS = ("configuration_manager_instance", "getElementByIdentifier", "application-settings-default", "maximumNumberOfConnections", "user_account_repository", "InternalServerErrorHandler")


def _spans(text: Column, pattern: str) -> tuple[Column, Column]:
    """The texts between the matches, and the matches; of texts without a match, none."""
    hit = text.rlike(pattern)
    empty = F.array().cast("array<string>")
    return (
        F.when(hit, F.split(text, pattern, -1)).otherwise(empty),
        F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty),
    )


_PLACED = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"
#: Spans put together at a time: a list that grows is copied for each span, one of lists for each such number.
CHUNK = 256


def _placed(between: Column, found: Column, kind: int) -> Column:
    """Spans with their text, from the lengths of what lies before each."""

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.length(F.get(between, i))
        end = start + F.length(F.get(found, i))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.get(found, i).alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).cast(_PLACED).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        last = F.least((c + 1) * CHUNK, F.size(found)) - 1
        first = F.struct(acc["pos"].alias("pos"), F.array().cast(_PLACED).alias("out"))
        inner = F.aggregate(F.sequence(c * CHUNK, last), first, step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["pos"].alias("pos"), F.concat(acc["all"], F.array(x["out"])).cast(f"array<{_PLACED}>").alias("all"))), F.lit(0))

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(f"array<{_PLACED}>").alias("all"))
    walked = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), start, chunk, lambda acc: F.flatten(acc["all"]))
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(_PLACED))


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(a["kind"] - b["kind"])


def _pairs(s: Column) -> Column:
    """Codes of neighbouring characters of an ASCII string."""
    return F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.ascii(s.substr(i, F.lit(1))) * 128 + F.ascii(s.substr(i + 1, F.lit(1))))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_random: int = SAMPLE_RANDOM) -> list[float]:
    """Log-likelihood ratios of the 128 x 128 transitions. At most 2 x 16,384 counts reach the driver."""
    spark = docs.sparkSession
    everything = texts(docs).select("text")
    share = min(1.0, sample_docs / max(1, everything.count()))
    sample = everything.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    digest = F.sha2(F.col("id").cast("string"), 256)
    rule = F.explode(F.array(digest, F.base64(F.unhex(digest)), F.translate(F.upper(F.base64(F.unhex(digest))), "+/=", "")))
    value = F.explode(F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 1), (ACCESS, 0), (HEX, 0)))))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    word = F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,64}"), F.lit(0)))
    known = spark.createDataFrame([(x,) for x in IDENTIFIERS], "s string")
    labelled = (
        spark.range(sample_random).select(rule.alias("s"), F.lit(1).alias("random"))
        .unionAll(sample.select(value.alias("s"), F.lit(1).alias("random")).where(F.length("s").between(16, 256)))
        .unionAll(sample.select(word.alias("s"), F.lit(0).alias("random")))
        .unionAll(known.select("s", F.lit(0).alias("random")))
    )
    counts = labelled.select("random", F.explode(_pairs(F.col("s"))).alias("pair")).groupBy("random", "pair").count()
    seen = [[0.5] * (128 * 128), [0.5] * (128 * 128)]
    for row in counts.collect():
        seen[row["random"]][row["pair"]] += row["count"]
    logs = []
    for table in seen:
        totals = [math.log(sum(table[a * 128 : a * 128 + 128])) for a in range(128)]
        logs.append([math.log(x) - totals[i // 128] for i, x in enumerate(table)])
    return [r - o for o, r in zip(*logs, strict=True)]


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """``doc_id``, ``text``, ``base`` and ``spans`` (arrays of start, end, kind, value by start, then kind) of every text.

    keep: also ``payload``, a struct of all input columns.
    """
    source = docs.select(F.struct("*").alias("payload"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")) if keep else texts(docs)
    text = F.col("text")
    split = source
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX, RUN)):
        between, found = _spans(text, pattern)
        split = split.withColumns({f"between{kind}": between, f"found{kind}": found})
    placed = split.select(*source.columns, *(_placed(F.col(f"between{k}"), F.col(f"found{k}"), k).alias(f"spans{k}") for k in range(4)))
    base = F.array_sort(F.concat(F.filter("spans0", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= LEAST_VALUE), F.col("spans1"), F.col("spans2")), _by_start)
    table = F.col("ratios")

    def random(s: Column) -> Column:
        """Mean log-likelihood ratio of a run's transitions."""
        chars = F.split(s["value"], "")
        total = F.aggregate(F.sequence(F.lit(0), F.length(s["value"]) - 2), F.lit(0.0), lambda acc, i: acc + F.get(table, F.ascii(F.get(chars, i)) * 128 + F.ascii(F.get(chars, i + 1))))
        return total / (F.length(s["value"]) - 1)

    based = placed.withColumn("base", base)
    # a run that holds a match of one of the other patterns overlaps a base span; others may lie inside an assignment
    free = F.filter("spans3", lambda s: ~s["value"].rlike(HEX) & ~s["value"].rlike(ACCESS) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    more = F.filter(free, lambda s: random(s) > threshold)
    model = docs.sparkSession.range(1).select(F.from_json(F.lit(json.dumps(ratios)), "array<double>").alias("ratios"))
    return based.crossJoin(F.broadcast(model)).withColumn("more", more).select(*source.columns, "base", F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"), _by_start)).otherwise(F.col("base")).alias("spans"))


def redact(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``scanned`` with ``text`` where each run of overlapping spans gives way to ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        before = F.col("text").substr((acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        joined = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), joined.alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))
    cut = F.aggregate("spans", first, step, lambda acc: F.concat(acc["out"], F.col("text").substr((acc["pos"] + 1).cast("int"), F.length("text"))))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, cut).otherwise(F.col("text")))


def joined(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text of ``documents``: counts of the base kinds, digest of the base spans, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
