"""Merging of identities whose rows alternate in time."""

import numpy as np
import pytest

from pitchlake.operators import tracking

SCHEMA = "frame int, tiempo_s double, id_jugador int, x_m double, y_m double"


def table(spark, rows):
    return spark.createDataFrame([(f, f / 25, i, float(x), float(y)) for f, i, x, y in rows], SCHEMA)


def brute(rows, window_s, together, apart):
    by = {}
    for f, i, x, y in sorted(rows):
        by.setdefault(i, {})[f] = (x, y)
    out = {}
    for a in by:
        for b in by:
            if a >= b:
                continue
            shared = by[a].keys() & by[b].keys()
            if together is not None and len(shared) >= together:
                continue
            if apart is not None and len(shared) >= 3 and np.median([np.hypot(*np.subtract(by[a][f], by[b][f])) for f in shared]) > apart:
                continue
            parts = {}
            for mine, other in ((by[a], by[b]), (by[b], by[a])):
                fs = sorted(mine)
                for f, p in other.items():
                    if fs[0] <= f <= fs[-1]:
                        at = [np.interp(f / 25, [g / 25 for g in fs], [mine[g][c] for g in fs]) for c in (0, 1)]
                        parts.setdefault(int(f / 25 // window_s) if window_s else 0, []).append(np.hypot(p[0] - at[0], p[1] - at[1]))
            if parts:
                out[a, b] = (len(shared), max(float(np.median(d)) for d in parts.values()))
    return out


@pytest.mark.parametrize("window_s, together, apart", [(None, None, None), (1.0, None, None), (2.0, 4, None), (None, None, 8.0)])
def test_costs_equal_brute_force(spark, window_s, together, apart):
    rng = np.random.default_rng(3)
    rows = [(3 * k, i, round(float(rng.uniform(0, 20)), 3), round(float(rng.uniform(0, 20)), 3)) for i in range(7) for k in range(5 * i, 60 + 3 * i) if rng.random() < 0.25]
    got = {(r["id_a"], r["id_b"]): (r["shared"], r["cost"]) for r in tracking.interleaved_costs(table(spark, rows), window_s=window_s, most_together=together, apart_m=apart).collect()}
    want = brute(rows, window_s, together, apart)
    assert want and set(got) == set(want)
    for p in want:
        assert got[p] == (want[p][0], pytest.approx(want[p][1], abs=1e-6))


def test_alternating_fragments_merge_and_coexisting_people_do_not(spark):
    one = [(3 * k, 1 if k % 2 else 2, 10 + 0.1 * k, 5) for k in range(60)]
    two = [(3 * k, i, 40 + 0.2 * i + 0.05 * k, 30) for k in range(60) for i in (3, 4)]
    rows = table(spark, one + two)
    got = tracking.roster_cap(rows, rows, 1).groupBy("id_jugador").count().collect()
    assert {r["id_jugador"]: r["count"] for r in got} == {1: 60, 3: 60, 4: 60}
