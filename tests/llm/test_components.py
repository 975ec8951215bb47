import random

import pytest

from weftline.llm import common
from weftline.llm.common import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2)], [(3, 2), (2, 3), (3, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(99, i) for i in range(80)],
    [(random.Random(7).randrange(300), random.Random(i).randrange(300)) for i in range(200)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    assert sorted(tuple(r) for r in components(df).collect()) == brute(edges)


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_hubs(spark, monkeypatch, most):
    """Stars whose centres are the least, the greatest and middle nodes, in a chain, beside small components."""
    monkeypatch.setattr(common, "HUB", 8)
    monkeypatch.setattr(common, "MOST_HUBS", most)
    edges = [(0, i) for i in range(1, 40)] + [(999, i) for i in range(100, 140)] + [(150, i) for i in range(141, 170)] + [(39, 999), (150, 100), (200, 201), (202, 201)] + [(300 + i, 301 + i) for i in range(12)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert found == {**{x: 0 for e in edges[:111] for x in e}, **{x: 200 for x in (200, 201, 202)}, **{300 + i: 300 for i in range(13)}}
