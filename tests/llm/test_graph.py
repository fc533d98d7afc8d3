import random

import numpy as np
import pytest

from pitchlake.llm import graph


def groups(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    out = {}
    for x in list(parent):
        out.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def shapes():
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1200)] + [(1000, 1001)] * 5
    ring = [(i, 2000 + (i + 1 - 2000) % 50) for i in range(2000, 2050)]
    loose = [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(120)]
    signed = [(-5, -9), (-9, 2**62), (2**62, -(2**63))]
    return [(a, b) for a, b in chain + star + ring + loose + signed if a != b]


def test_roots_of_one_partition():
    edges = shapes()
    a, b = np.array(edges, "i8").T
    nodes, found = graph.roots(a, b, 1)
    by_root = {}
    for n, r in zip(nodes.tolist(), found.tolist(), strict=True):
        by_root.setdefault(r, set()).add(n)
    assert sorted(map(sorted, by_root.values())) == groups(edges) and all(r in s for r, s in by_root.items())


@pytest.mark.parametrize(("parts", "links"), [(1, 1 << 17), (7, 1 << 17), (40, 10)])
def test_components_over_partitions(spark, monkeypatch, parts, links):
    monkeypatch.setattr(graph, "TASK_LINKS", links)
    edges = shapes()
    df = spark.createDataFrame([*edges, (77, 77)], "a long, b long").repartition(parts)
    by_label = {}
    rows = graph.components(df).collect()
    for r in rows:
        by_label.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, by_label.values())) == groups(edges) and len(rows) == len({r["node"] for r in rows})
    assert graph.components(df.limit(0)).count() == 0
