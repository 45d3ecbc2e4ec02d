import random

from patchweave.operators import hot_keys
from patchweave.operators.components import components


def plain(edges):
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def test_hubs_chains_and_loops(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 20)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(80)] + [(1_000, 1_000 + k) for k in range(1, 150)]
    edges += [(1_000 + k, 2_000 + k) for k in range(1, 30)] + [(3_000 + k, 3_001 + k) for k in range(20)] + [(7, 7), (900, 900)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == plain(edges)
    assert components(df.filter("false")).count() == 0


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 3)
    rows = [("hot", k) for k in range(10)] + [("cold", 1), ("cold", 1), (None, 2), ("alone", 3)]
    left = spark.createDataFrame(rows, "k string, x int")
    right = spark.createDataFrame([("hot", 5, 10), ("cold", 6, 2), ("other", 7, 0)], "k string, y int, n long")
    got = hot_keys.join_counted(left, right, "k", "n", len(rows))
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted([("hot", k, 5) for k in range(10)] + [("cold", 1, 6)] * 2)
