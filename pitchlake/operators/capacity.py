"""Team labels under the numbers that the rules of the game allow, for whole identities or pieces of them.

In no frame may more than ``cap`` people be of a team or more than ``others`` of
neither; whoever is beyond costs ``slack`` for each frame. Among all labellings of
the units the one of least cost is chosen: the units' own costs and what excess
costs. Frames with the same people are one rule with their number as its weight.
Units that share a rule are linked; each connected part of that graph is a problem
of its own and a group of its own, solved exactly by branch and bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from .lineage import saved
from .teams import Prototypes, vector_means
from .tracking import components

LABELS = ("A", "B", "otro")
#: Nodes of one part's search after which the best labelling found is given, marked as not proven.
#: The problem is NP-hard; a part whose colours decide nothing can need more nodes than any number given here.
MOST_NODES = 400
_EPS = 1e-9


@dataclass
class Part:
    """Units by number with their costs (n x 3; infinite: not allowed) and rules: members, label, room and price of one too many."""

    cost: np.ndarray
    members: list[np.ndarray]
    label: np.ndarray
    room: np.ndarray
    price: np.ndarray

    def total(self, chosen: np.ndarray) -> float:
        over = sum(p * max(0, int((chosen[m] == j).sum()) - r) for m, j, r, p in zip(self.members, self.label, self.room, self.price, strict=True))
        return float(self.cost[np.arange(len(chosen)), chosen].sum() + over)

    def only(self, units: np.ndarray, rules: list[int]) -> Part:
        place = np.full(len(self.cost), -1)
        place[units] = np.arange(len(units))
        return Part(self.cost[units], [place[self.members[r]] for r in rules], self.label[rules], self.room[rules], self.price[rules])

    def fixed(self, unit: int, label: int) -> Part:
        """Without ``unit``, which takes ``label``; rooms may become negative."""
        rest = np.delete(np.arange(len(self.cost)), unit)
        members, room = [], self.room.copy()
        for r, m in enumerate(self.members):
            here = m == unit
            if here.any() and self.label[r] == label:
                room[r] -= 1
            m = m[~here]
            members.append(m - (m > unit))
        return Part(self.cost[rest], members, self.label, room, self.price)


def _rules_that_bind(p: Part) -> tuple[list[int], float]:
    """Rules that some labelling breaks and another keeps or breaks less; and the cost of what all break."""
    allowed, bind, sure = np.isfinite(p.cost), [], 0.0
    for r, m in enumerate(p.members):
        may = int(allowed[m, p.label[r]].sum())
        must = int((allowed[m].sum(axis=1) == 1)[allowed[m, p.label[r]]].sum()) if len(m) else 0
        if may <= p.room[r]:
            continue
        if must == may:
            sure += float(p.price[r] * (may - p.room[r]))
        else:
            bind.append(r)
    return bind, sure


def _dual(p: Part, start: np.ndarray, best: float, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """A lower bound: prices of room between 0 and those of excess, moved where room lacks. The bound, the prices, the units' costs under them."""
    rule = np.repeat(np.arange(len(p.members)), [len(m) for m in p.members])
    unit = np.concatenate(p.members) if p.members else np.zeros(0, int)
    price, top, scale = start.copy(), (-np.inf, start, p.cost), 1.0
    for _ in range(steps):
        reduced = p.cost.copy()
        np.add.at(reduced, (unit, p.label[rule]), price[rule])
        value = float(reduced.min(axis=1).sum() - price @ p.room)
        if value > top[0] + _EPS:
            top = (value, price.copy(), reduced)
        else:
            scale *= 0.9
        if best - top[0] <= _EPS:
            break
        lacks = np.bincount(rule, reduced.argmin(axis=1)[unit] == p.label[rule], len(p.members)) - p.room
        lacks[(price <= 0) & (lacks < 0) | (price >= p.price) & (lacks > 0)] = 0
        size = float(lacks @ lacks)
        if size == 0:
            break
        price = np.clip(price + scale * (best - value) / size * lacks, 0, p.price)
    return top


def _descended(p: Part, chosen: np.ndarray) -> tuple[float, np.ndarray]:
    """A labelling that no change of one unit, and no exchange of two labels, makes cheaper."""
    chosen = chosen.copy()
    counts = np.array([(chosen[m] == j).sum() for m, j in zip(p.members, p.label, strict=True)], float)
    sizes = [len(m) for m in p.members]
    unit, rule = np.concatenate([np.zeros(0, int), *p.members]), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(unit, kind="stable")
    own = np.split(rule[order], np.searchsorted(unit[order], np.arange(1, len(chosen))))  # the rules of each unit

    def excess(rules: np.ndarray, change: np.ndarray) -> float:
        """What ``change`` of the counts of some rules costs."""
        c, room = counts[rules], p.room[rules]
        return float(p.price[rules] @ (np.maximum(0, c + change - room) - np.maximum(0, c - room)))

    def turned(k: int, j: int, rules: np.ndarray) -> np.ndarray:
        return (p.label[rules] == j).astype(float) - (p.label[rules] == chosen[k])

    better = True
    while better:
        better = False
        for k, rules in enumerate(own):
            for j in np.flatnonzero(np.isfinite(p.cost[k])).tolist():
                if j != chosen[k] and p.cost[k, chosen[k]] - p.cost[k, j] - excess(rules, change := turned(k, j, rules)) > _EPS:
                    counts[rules] += change
                    chosen[k], better = j, True
        if not better and len(chosen) <= 40:
            for k in range(len(chosen)):
                for i in range(k):
                    a, b = int(chosen[k]), int(chosen[i])
                    if a != b and np.isfinite(p.cost[k, b]) and np.isfinite(p.cost[i, a]):
                        rules, at = np.unique(np.concatenate([own[k], own[i]]), return_inverse=True)
                        change = np.zeros(len(rules))
                        np.add.at(change, at, np.concatenate([turned(k, b, own[k]), turned(i, a, own[i])]))
                        if p.cost[k, a] + p.cost[i, b] - p.cost[k, b] - p.cost[i, a] - excess(rules, change) > _EPS:
                            counts[rules] += change
                            chosen[k], chosen[i], better = b, a, True
    return p.total(chosen), chosen


def _parts(n: int, members: list[np.ndarray], rules: list[int]) -> list[tuple[np.ndarray, list[int]]]:
    """Units and rules that hang together."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in rules:
        for k in members[r][1:].tolist():
            root[find(k)] = find(int(members[r][0]))
    top = np.array([find(k) for k in range(n)], int)
    return [(np.flatnonzero(top == t), [r for r in rules if top[members[r][0]] == t]) for t in np.unique(top)]


def solve(p: Part, most_nodes: int = MOST_NODES) -> tuple[np.ndarray, bool]:
    """The cheapest label of each unit, and whether it is proven to be."""
    left = [most_nodes]

    def search(p: Part) -> tuple[np.ndarray, bool]:
        chosen, proven = np.zeros(len(p.cost), int), True
        rules, _ = _rules_that_bind(p)
        for units, own in _parts(len(p.cost), p.members, rules):
            if not own:
                chosen[units] = p.cost[units].argmin(axis=1)
            else:
                chosen[units], sure = branch(p.only(units, own))
                proven &= sure
        return chosen, proven

    def branch(p: Part) -> tuple[np.ndarray, bool]:
        left[0] -= 1
        price = np.minimum(p.price, np.abs(p.cost[np.isfinite(p.cost)]).mean() * 0.1)
        best, chosen = _descended(p, p.cost.argmin(axis=1))
        bound, price, reduced = _dual(p, price, best, 200)
        other, also = _descended(p, reduced.argmin(axis=1))
        if other < best - _EPS:
            best, chosen = other, also
            bound, price, reduced = max((bound, price, reduced), _dual(p, price, best, 60), key=lambda x: x[0])
        if best - bound <= _EPS * max(1.0, abs(best)) or left[0] <= 0:
            return chosen, best - bound <= _EPS * max(1.0, abs(best))
        beyond = reduced - reduced.min(axis=1, keepdims=True)
        cost = np.where(bound + beyond > best + _EPS, np.inf, p.cost)  # such a label is in no better labelling
        if (np.isinf(cost) & np.isfinite(p.cost)).any():
            cost[np.arange(len(chosen)), chosen] = p.cost[np.arange(len(chosen)), chosen]
            found, sure = search(Part(cost, p.members, p.label, p.room, p.price))
            return (found, sure) if p.total(found) < best - _EPS else (chosen, sure)
        ruled = np.bincount(np.concatenate(p.members), minlength=len(p.cost))
        unit = int(np.argmax(ruled - np.partition(beyond, 1, axis=1)[:, 1] / (1 + beyond[np.isfinite(beyond)].max())))
        proven = True
        for label in np.argsort(reduced[unit], kind="stable").tolist():
            if not np.isfinite(p.cost[unit, label]) or bound + beyond[unit, label] >= best - _EPS:
                continue
            found, sure = search(p.fixed(unit, label))
            proven &= sure
            found = np.insert(found, unit, label)
            if (value := p.total(found)) < best - _EPS:
                best, chosen = value, found
        return chosen, proven

    return search(p)


def capped_units(units: DataFrame, present: DataFrame, fixed: DataFrame | None = None, cap: int = 7, others: int = 1, slack: float = 1.0, most_nodes: int = MOST_NODES) -> DataFrame:
    """``unit, label, proven``: the labelling of least cost under the numbers.

    units: ``unit`` and the costs ``a, b, other`` of its labels. present: ``frame, unit``,
    who is on the pitch when. fixed: ``frame, a, b, other``, how many with a label of
    their own are there too. Frames and units of several matches are unique over all
    (``plans.matches``); matches then share no rule and so no part.
    """
    sets = present.join(units.select("unit"), "unit", "left_semi").groupBy("frame").agg(F.array_sort(F.collect_set("unit")).alias("who"))
    if fixed is not None:
        sets = sets.join(fixed.select("frame", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("other").alias("_o")), "frame", "left")
    taken = lambda c: F.coalesce(F.col(c), F.lit(0)) if fixed is not None else F.lit(0)
    room = {"ra": F.lit(cap) - taken("_a"), "rb": F.lit(cap) - taken("_b"), "ro": F.lit(others) - taken("_o")}
    rules = sets.select("who", *(c.cast("int").alias(n) for n, c in room.items())).where(F.size("who") > F.least("ra", "rb", "ro")).groupBy("who", "ra", "rb", "ro").agg(F.count("*").alias("n"))
    rules = saved(rules)
    first = F.get("who", F.lit(0))
    links = rules.where(F.size("who") > 1).select(first.alias("a"), F.explode(F.slice("who", 2, F.size("who") - 1)).alias("b")).distinct()
    named = components(units.select(F.col("unit").alias("tracklet_id")), links).select(F.col("tracklet_id").alias("unit"), F.col("identity_id").alias("part"))
    costs = units.select("unit", "a", "b", "other").join(named, "unit")
    own = rules.join(named.withColumnRenamed("part", "part_"), first == F.col("unit")).select(F.col("part_").alias("part"), "who", "ra", "rb", "ro", "n")
    kind = dict(units.dtypes)["unit"]

    def run(c: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("unit")
        ids = c["unit"].to_numpy()
        lines = [(np.searchsorted(ids, np.asarray(who)), j, room, slack * n) for who, ra, rb, ro, n in r[["who", "ra", "rb", "ro", "n"]].itertuples(index=False) for j, room in enumerate((ra, rb, ro)) if len(who) > room]
        lines.sort(key=lambda x: (x[1], x[2], x[3], x[0].tolist()))
        part = Part(c[["a", "b", "other"]].to_numpy(float), [x[0] for x in lines], *(np.array([x[i] for x in lines], t) for i, t in ((1, int), (2, int), (3, float))))
        chosen, proven = solve(part, most_nodes)
        return pd.DataFrame({"unit": ids, "label": [LABELS[j] for j in chosen], "proven": proven})

    return costs.groupBy("part").cogroup(own.groupBy("part")).applyInPandas(run, f"unit {kind}, label string, proven boolean")


def chunks(rows: DataFrame, chunk_s: float | None = 1.5, key: str = "id_jugador", t: str = "tiempo_s") -> DataFrame:
    """Rows with ``unit``: pieces of ``chunk_s`` seconds of an identity, counted from its first row; without a length the identity itself."""
    if chunk_s is None:
        return rows.withColumn("unit", F.col(key).cast("bigint"))
    since = F.col(t) - F.min(t).over(W.partitionBy(key))
    return rows.withColumn("unit", F.col(key).cast("bigint") * 1_000_000 + F.floor(since / chunk_s))


def colour_costs(crops: DataFrame, p: Prototypes, vector: str = "feat", fires: str | None = None) -> DataFrame:
    """Costs of units by colour: the number of crops times the distance of their mean to each prototype.

    crops: ``unit``, the vector, and (``fires``) whether a crop looks like a referee's kit; the share
    that does lowers the cost of being neither. Without a third prototype that cost is the distance of both teams.
    """
    means = vector_means(crops, ["unit"], vector)
    n = crops.groupBy("unit").agg(F.count("*").alias("n"), (F.avg(F.col(fires).cast("double")) if fires else F.lit(0.0)).alias("f"))
    away = lambda v: fn.norm(F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, v)), lambda x, y: x - y))
    other = away(p.other) if p.other is not None else F.lit(float(np.linalg.norm(np.array(p.a) - np.array(p.b))))
    return means.join(n, "unit").select("unit", (F.col("n") * away(p.a)).alias("a"), (F.col("n") * away(p.b)).alias("b"), (F.col("n") * (1 - F.col("f")) * other).alias("other"))


def label_rows(rows: DataFrame, p: Prototypes, cap: int = 7, others: int = 1, slack: float = 1.0, chunk_s: float | None = None, length: float = 100.0, width: float = 64.0, key: str = "id_jugador", most_nodes: int = MOST_NODES) -> DataFrame:
    """Rows (``frame, tiempo_s, id_jugador, etiqueta, x_m, y_m, feat``) with ``label``: keepers and staff keep theirs, and so do units without a crop; all others are labelled together.

    Keepers count for their team, units without a crop as what they are, staff for nothing; only who stands on the pitch counts.
    """
    own = saved(chunks(rows, chunk_s, key))
    kept = F.col("etiqueta").isin("portero_A", "portero_B", "staff")
    free = own.where(~kept)
    units = saved(colour_costs(free.where(F.col("feat").isNotNull()).select("unit", "feat"), p))
    inside = F.col("x_m").between(0, length) & F.col("y_m").between(0, width)
    present = free.where(inside).select("frame", "unit").distinct()
    still = own.where(inside & (F.col("etiqueta") != "staff")).join(units.select("unit", F.lit(True).alias("_free")), "unit", "left").where(kept | F.col("_free").isNull())
    count = lambda *names: F.count_distinct(F.when(F.col("etiqueta").isin(*names), F.col("unit"))).cast("int")
    fixed = still.groupBy("frame").agg(count("A", "portero_A").alias("a"), count("B", "portero_B").alias("b"), count("otro").alias("other"))
    found = capped_units(units, present, fixed, cap, others, slack, most_nodes)
    return own.join(found, "unit", "left").withColumn("label", F.when(kept, F.col("etiqueta")).otherwise(F.coalesce("label", "etiqueta"))).select(*rows.columns, "unit", "label", "proven")
