"""Relinking at crossings against a plain walk over each identity's rows."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import crossings

COLUMNS = "id_jugador int, frame int, tiempo_s double, x_m double, y_m double, crossed boolean, feat array<double>"


def plain(rows, vector=False, separation=1.0, v_cap=10.0, most_s=1.0, most_m=1.5, growth=0.0, weight=0.5, most_look=0.973, share=0.2):
    """Chains as {(id, frame): (first piece, kept)}."""
    parts = []
    for i, own in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        current, n = None, 0
        for crossed, run in itertools.groupby(list(own), key=lambda r: r[5]):
            run = list(run)
            if not crossed:
                if current is not None and not current["clean"]:
                    current["clean"] = run  # a crossing at the start goes with the first clean run
                else:
                    n += 1
                    current = {"name": i * crossings.PIECES + n, "clean": run, "fused": [], "n": n, "enters": False}
                    parts.append(current)
            elif current is None:
                n += 1
                current = {"name": i * crossings.PIECES + n, "clean": [], "fused": run, "n": n, "enters": False}
                parts.append(current)
            else:
                current["fused"] += run
                current["enters"] = True

    def model(series):
        m = None
        for r in series:
            if r[6] is not None:
                m = np.array(r[6]) if m is None else (1 - share) * m + share * np.array(r[6])
        return m

    cost = {}
    for a, b in itertools.product(parts, parts):
        if a is b or not (a["clean"] and b["clean"] and a["enters"] and b["n"] > 1):
            continue
        z, s, late = a["clean"][-1], b["clean"][0], a["clean"][-5:]
        dt = s[2] - z[2]
        if not 0 < dt <= most_s:
            continue
        p, q = np.array(z[3:5]), np.array(s[3:5])
        v = (p - late[0][3:5]) / (z[2] - late[0][2]) if z[2] > late[0][2] else np.zeros(2)
        v *= min(1, v_cap / max(np.linalg.norm(v), 1e-12))
        away, most = np.linalg.norm(p + v * dt - q), most_m + growth * dt
        looks = (model(a["clean"]), model(b["clean"][:10][::-1])) if vector else (None, None)
        apart = np.linalg.norm(looks[0] - looks[1]) / separation if looks[0] is not None and looks[1] is not None else None
        if away <= most and (apart is None or apart <= most_look):
            cost[a["name"], b["name"]] = away / most + weight * (apart or 0)
    best = {}
    for _, ((size, total), chosen) in [((0, 0), ((0, 0.0), {})), *(((0, 0), x) for x in assignments(cost))]:
        if not best or (-size, total) < best["key"]:
            best = {"key": (-size, total), "links": chosen}
    follow, by = best["links"], {p["name"]: p for p in parts}
    out = {}
    for p in parts:
        if p["name"] in follow.values():
            continue
        at, seen, name = p["name"], set(), p["name"]
        chain = []
        while at is not None:
            chain.append(at)
            at = follow.get(at)
        name = min(chain)
        for k, at in enumerate(chain):
            until = by[chain[k + 1]]["clean"][0][2] if k + 1 < len(chain) else np.inf
            for r in sorted(by[at]["clean"] + by[at]["fused"], key=lambda r: r[1]):
                kept = r[2] < until and r[1] not in seen
                if r[2] < until:
                    seen.add(r[1])
                out[r[0], r[1]] = (name, kept)
    return out


def assignments(cost):
    """All sets of links with one successor and one predecessor each: their size and cost."""
    def grow(pairs, used_a, used_b, total, chosen):
        yield (len(chosen), total), dict(chosen)
        for i, (a, b) in enumerate(pairs):
            if a not in used_a and b not in used_b:
                yield from grow(pairs[i + 1 :], used_a | {a}, used_b | {b}, total + cost[a, b], [*chosen, (a, b)])

    yield from grow(sorted(cost), frozenset(), frozenset(), 0.0, [])


def made(seed):
    """A few people on lines through one another, now and then unseen; boxes touch where they are near."""
    rng = np.random.default_rng(seed)
    start, v = rng.uniform(0, 12, (4, 2)), rng.uniform(-3, 3, (4, 2))
    rows = []
    for f in range(0, 60, 3):
        at = start + v * f / 25
        for i in range(4):
            near = np.sort(np.linalg.norm(at - at[i], axis=1))[1] < 1.6
            if rng.random() < 0.9:
                rows.append((i + 1, f, f / 25, *map(float, at[i] + rng.normal(0, 0.1, 2)), bool(near or rng.random() < 0.04), [float(i % 2), float(1 - i % 2)] if rng.random() < 0.8 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_plain_walk(spark, seed):
    rows = made(seed)
    for vector in (False, True):
        want = plain(rows, vector, separation=1.5, growth=0.3)
        got = crossings.relink(spark.createDataFrame(rows, COLUMNS), growth=0.3, vector="feat" if vector else None, separation=1.5)
        assert {(r["id_jugador"], r["frame"]): (r["piece_id"], r["kept"]) for r in got.collect()} == want


def test_a_swap_is_undone(spark):
    """Two people whose names were exchanged in a crossing get them back by their motion; a slow look-alike does not."""
    rows = []
    for f in range(0, 75, 3):
        t = f / 25
        for person, x in ((1, 4 * t), (2, 12 - 4 * t)):
            rows.append((person if f < 36 else 3 - person, f, t, x, 5.0, abs(x - 6) < 1.2, None))
    chain = {(r["id_jugador"], r["frame"]): r["piece_id"] for r in crossings.relink(spark.createDataFrame(rows, COLUMNS)).where("kept").collect()}
    assert chain[1, 0] == chain[2, 72] and chain[2, 0] == chain[1, 72] and chain[1, 0] != chain[2, 0]


def test_matches_apart_and_random_cuts(spark):
    one = spark.createDataFrame(made(5), COLUMNS)
    two = one.withColumn("match_no", F.lit(0)).unionByName(one.withColumns({"match_no": F.lit(1), "id_jugador": F.col("id_jugador") + 100}))
    count = lambda df: Counter((r["id_jugador"] % 100, r["frame"], r["piece_id"] % (100 * crossings.PIECES), r["kept"]) for r in df.collect())
    assert count(crossings.relink(two, match=["match_no"])) == count(crossings.relink(one)) + count(crossings.relink(one))
    cut = crossings.random_cuts(one, 3)
    entries = lambda df: Counter(i for i, rows in itertools.groupby(sorted(map(tuple, df.select("id_jugador", "frame", "crossed").collect())), key=lambda r: r[0]) for a, b in itertools.pairwise(rows) if b[2] and not a[2])
    n = {r["id_jugador"]: r["n"] for r in cut.groupBy("id_jugador").agg(F.count(F.when(F.col("crossed"), 1)).alias("n")).collect()}
    assert {k: v for k, v in n.items() if v} == entries(one) and cut.columns == one.columns
    assert crossings.random_cuts(one, 4).where("crossed").select("id_jugador", "frame").exceptAll(cut.where("crossed").select("id_jugador", "frame")).count() > 0


def test_without_rows_or_links(spark):
    assert crossings.relink(spark.createDataFrame([], COLUMNS)).count() == 0
    lone = spark.createDataFrame([(1, f, f / 25, 1.0, 1.0, f < 3, None) for f in range(0, 12, 3)], COLUMNS)
    assert {(r["piece_id"], r["kept"]) for r in crossings.relink(lone).collect()} == {(crossings.PIECES + 1, True)}
