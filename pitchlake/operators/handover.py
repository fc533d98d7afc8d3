"""Readers that carry a state along a match, in many tasks.

A match is cut into pieces of time. A piece first guesses the state it starts with:
it reads the ``warm`` seconds before it from nothing. Where the state that the piece
before ends with is another one, the piece is read again from that, until none
differs; then each has started from the state that one reading would have there.
What is left after a while of tracks or cheapest paths seldom depends on how they
began, so few pieces are read again. A task holds one piece and one state.

A state is a list of numbers, ordered by content; equal states have equal lists.
``read(state, rows)`` takes a state (None: the beginning) and rows in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import folder, saved

#: ``state, rows`` to a number for each row, the numbers of the tracks left open in the order of the state, how many are new, and the state.
Reader = Callable[[np.ndarray | None, pd.DataFrame], tuple[np.ndarray, np.ndarray, int, np.ndarray]]
#: ``state, rows, loads`` to the same, and for each track left the places of the rows it took values from here, and which tracks of the state were asked for theirs (by place in it).
Carrier = Callable[[np.ndarray | None, pd.DataFrame, list], tuple[np.ndarray, np.ndarray, int, np.ndarray, list[list[int]], list[int]]]


def pieces(rows: DataFrame, seconds: float, warm: float, key: list[str] | None = None, t: str = "t") -> DataFrame:
    """``rows`` with ``_n``, the piece of their match from 0, and again as ``_warm`` rows of the piece after; ``_last``: of a match's last piece."""
    own = key or []
    cut = saved(rows.where(F.col(t).isNotNull()).withColumn("_s", F.floor(F.col(t) / seconds).cast("bigint")))
    order = W.partitionBy(*own).orderBy("_s")
    # a row for each piece that has rows
    numbers = cut.select(*own, "_s").distinct().withColumns({"_n": (F.row_number().over(order) - 1).cast("int"), "_last": F.lead("_s").over(order).isNull()})
    numbers = numbers.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(own)} | {"_s": "_ks"})
    dealt = cut.join(numbers, [cut["_s"] == F.col("_ks"), *(cut[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(own))])
    before = dealt.where((F.col(t) >= (F.col("_s") + 1) * seconds - warm) & ~F.col("_last"))
    both = dealt.withColumn("_warm", F.lit(False)).unionByName(before.withColumns({"_warm": F.lit(True), "_n": F.col("_n") + 1}))
    return saved(both.select(*rows.columns, "_n", "_last", "_warm"))


def _named(df: DataFrame, key: list[str]) -> tuple[DataFrame, list]:
    """``df`` with other names for its piece, and the condition that joins it to one that has them."""
    named = df.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(key)} | {"_n": "_m"})
    return named, [F.col("_n") == F.col("_m"), *(F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key))]


def settled(parts: DataFrame, read: Callable[[np.ndarray | None, pd.DataFrame], np.ndarray], order: list[str], key: list[str] | None = None) -> DataFrame:
    """``key, _n, start``: the state in which each piece of ``pieces`` starts. ``read`` gives the state after the rows."""
    own = key or []
    names = [*own, "_n", "start", "end"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*own, "_n").schema) + ", start array<double>, end array<double>"

    def row(k: tuple, start: np.ndarray, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*k, start.tolist(), read(start, g).tolist())], columns=names)

    def guess(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        return row(k, read(None, g[g["_warm"]]), g[~g["_warm"]])

    def again(k: tuple, g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return row(k, np.asarray(s["start"].iloc[0], float), g.sort_values(order))

    states = saved(parts.groupBy(*own, "_n").applyInPandas(guess, schema))
    mine = parts.where("not _warm")
    while True:
        ends, same = _named(states.select(*own, (F.col("_n") + 1).alias("_n"), F.col("end").alias("_end")), own)
        wrong = saved(states.join(ends, same).where("start <> _end").select(*own, "_n", F.col("_end").alias("start")))
        if wrong.isEmpty():
            return states.drop("end")
        named, same = _named(wrong.drop("start"), own)
        some = mine.join(named, same, "left_semi")
        new = some.groupBy(*own, "_n").cogroup(wrong.groupBy(*own, "_n")).applyInPandas(again, schema)
        states = saved(states.join(named, same, "left_anti").unionByName(new))


def from_start(parts: DataFrame, states: DataFrame, run: Callable, schema: str, order: list[str], key: list[str] | None = None) -> DataFrame:
    """``run(group, rows, state's row)`` for each piece, its own rows in order."""
    own = key or []

    def each(k: tuple, g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return run(k, g.sort_values(order), s.iloc[0])

    return parts.where("not _warm").groupBy(*own, "_n").cogroup(states.groupBy(*own, "_n")).applyInPandas(each, schema)


def tracked(rows: DataFrame, read: Reader | Carrier, seconds: float, warm: float, order: list[str], keep: list[str], key: str | None = None, load: str | None = None, most: int = 0) -> DataFrame:
    """``keep`` of each row and ``tracklet_id``, the number of its track in its match by order of beginning; rows without a track are left out.

    In a piece the tracks that were open at its start have negative numbers, by their
    place in the state, new ones positive numbers from 1. A piece is read once, from
    its guess, and again only where that was wrong. One task for each match goes
    through its pieces in order, without their rows: a few numbers for each open track.

    ``load`` names a column of arrays (empty: nothing) of which a track carries the last
    ``most`` along. It may carry them for hours, so no piece can guess them; but only pieces
    that ask for them depend on them. The others hand them on unread, as numbers of rows.
    """
    own = [key] if key else []
    parts = pieces(rows.withColumn("_id", F.monotonically_increasing_id()), seconds, warm, own)
    fields = lambda *c: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*own, "_n", *c).schema)
    # rows of a piece, and one row that tells how it was read
    schema = fields(*keep) + ", _local long, _told string"

    def numbers(g: pd.DataFrame, taken: list[list[int]]) -> list[list[int]]:
        return [g["_id"].iloc[one].tolist() for one in taken]

    def piece(k: tuple, g: pd.DataFrame, start: np.ndarray, held: list, loads: list) -> pd.DataFrame:
        mine, left, new, end, *more = read(start, g, loads) if load else read(start, g)
        fresh, asked = more or ([], [])
        out = g[[*own, "_n", *keep]].assign(_local=mine, _told=None)[mine != 0]
        how = {"start": start.tolist(), "end": end.tolist(), "left": left.tolist(), "new": new, "held": held, "fresh": numbers(g, fresh), "asked": asked}
        told = pd.DataFrame([(*k, json.dumps(how))], columns=[*own, "_n", "_told"]).reindex(columns=out.columns)
        return pd.concat([out, told]) if len(out) else told

    def guess(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        before = g[g["_warm"]]
        _, _, _, start, *more = read(None, before)
        taken = more[0] if more else []
        loads = [before[load].iloc[one].tolist() for one in taken]
        return piece(k, g[~g["_warm"]], start, numbers(before, taken), loads)

    def again(k: tuple, g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        state = s[s["_of"] < 0].iloc[0]
        held = [list(map(int, one)) for one in state["_held"]]
        what = dict(zip(s["_of"].tolist(), s[load].tolist(), strict=True)) if load else {}
        return piece(k, g.sort_values(order), np.asarray(state["_start"], float), held, [[what[i] for i in one] for one in held])

    def known(i: int, some: list, other):
        return some[i] if i < len(some) else other

    def linked(k: tuple, s: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        names, loads, end, count = [], [], [], 0
        s = s.sort_values(["_n", "_v"]).drop_duplicates("_n", keep="last")
        for n, v, how in zip(s["_n"].tolist(), s["_v"].tolist(), s["_told"].map(json.loads), strict=True):
            wrong = not np.array_equal(how["start"], end, equal_nan=True) or any(how["held"][i] != loads[i] for i in how["asked"])
            out.append((*k, n, v, wrong, count, names, end if wrong else None, loads if wrong else None))
            # a piece that was read from another number of tracks is read again; what follows is a guess till then
            fresh = how["fresh"] or [[]] * len(how["left"])
            loads = [(f if x > 0 else [*known(-x - 1, loads, []), *f])[-most:] if most else [] for x, f in zip(how["left"], fresh, strict=True)]
            names = [count + x if x > 0 else known(-x - 1, names, 0) for x in how["left"]]
            end, count = how["end"], count + how["new"]
        return pd.DataFrame(out, columns=[*own, "_n", "_v", "_wrong", "_before", "_names", "_start", "_held"])

    base, v = folder(rows.sparkSession, "tracked"), 0
    mine = parts.where("not _warm")
    found = parts.groupBy(*own, "_n").applyInPandas(guess, schema)
    while True:
        found.write.parquet(f"{base}/_v={v}")
        every = rows.sparkSession.read.schema(f"{schema}, _v int").parquet(base)
        states = every.where("_told is not null").select(*own, "_n", "_v", "_told")
        links = saved(states.groupBy(*own).applyInPandas(linked, fields() + ", _v int, _wrong boolean, _before long, _names array<long>, _start array<double>, _held array<array<long>>"))
        wrong = links.where("_wrong").select(*own, "_n", "_start", "_held")
        if wrong.isEmpty():
            break
        named, same = _named(wrong.select(*own, "_n"), own)
        given = wrong.withColumn("_of", F.lit(-1).cast("long"))
        if load:
            values = mine.where(F.size(load) > 0).select("_id", load)
            held = wrong.select(*own, "_n", F.explode(F.array_distinct(F.flatten("_held"))).alias("_of"))
            given = given.unionByName(held.join(values, F.col("_of") == F.col("_id")).drop("_id"), allowMissingColumns=True)
        found, v = mine.join(named, same, "left_semi").groupBy(*own, "_n").cogroup(given.groupBy(*own, "_n")).applyInPandas(again, schema), v + 1
    last = links.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(own)), F.col("_n").alias("_m"), F.col("_v").alias("_w"), "_before", "_names")
    numbered = every.where("_local is not null").join(last, [F.col("_n") == F.col("_m"), F.col("_v") == F.col("_w"), *(F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(own))])
    number = F.when(F.col("_local") > 0, F.col("_before") + F.col("_local")).otherwise(F.get("_names", (-F.col("_local") - 1).cast("int")))
    return numbered.select(*own, *keep, number.cast("int").alias("tracklet_id"))
