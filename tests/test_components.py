import random

from pyspark.sql import functions as F

from neardup.operators.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    out = {}
    for x in list(parent):
        out[x] = find(x)
    # component label = smallest member
    mins = {}
    for x, r in out.items():
        mins[r] = min(mins.get(r, x), x)
    return {x: mins[r] for x, r in out.items()}


def test_transitive_chain(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}


def test_random_graphs_match_union_find(spark):
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
        edges += [(i, i + 1) for i in range(500, 560)]          # a long path (diameter 60)
        edges = [(a, b) for a, b in edges if a != b]
        df = spark.createDataFrame(edges, "src long, dst long")
        got = {r.id: r.component for r in connected_components(df).collect()}
        assert got == union_find(edges)


def test_order_invariance(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 1), (7, 8)]
    a = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    b = {r.id: r.component for r in connected_components(
        spark.createDataFrame([(d, s) for s, d in reversed(edges)], "src long, dst long")).collect()}
    assert a == b == union_find(edges)


def test_hub_star(spark):
    edges = [(0, i) for i in range(1, 400)] + [(399, 1000)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert got.select("component").distinct().collect()[0].component == 0
    assert got.count() == 401
