from __future__ import annotations

import random

from tidetrace.llm.components import components


def brute(edges):
    low = {n: n for e in edges for n in e}
    while True:
        new = dict(low)
        for u, v in edges:
            new[u] = new[v] = min(new[u], new[v])
        if new == low:
            return low
        low = new


def test_random_graphs(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)]
    edges += [(i, i + 1) for i in range(1000, 1060)]  # a path
    edges += [(2000, i) for i in range(2001, 2400)] + [(3000 + i, 5000) for i in range(300)]  # hubs
    got = components(spark.createDataFrame(edges + edges[:20] + [(7, 7), (None, 3)], "u long, v long")).collect()
    real = [e for e in edges if e[0] != e[1]]
    assert {r.node: r.component for r in got} == brute(real)
    assert len(got) == len({n for e in real for n in e})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
