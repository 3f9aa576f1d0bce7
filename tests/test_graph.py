import random

from pyspark.sql import functions as F

from grovewise.operators import graph, layers


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(70)] + [("h", f"s{i}") for i in range(30)] + [("x", "y"), ("y", "x"), ("x", "x")]
    edges += [(f"r{rng.randrange(60):02d}", f"r{rng.randrange(60):02d}") for _ in range(40)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    loops = {a for a, b in edges if a == b} - {v for a, b in edges if a != b for v in (a, b)}
    got = {r["v"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: find(v) for v in up if v not in loops}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_anchor_and_neighbours(spark, rows):
    m = spark.createDataFrame([("c", "t1", 2), ("c", "t2", 5), ("c", "t0", 5)], "component string, tip string, n int")
    assert rows(graph.anchors(m, "component", "tip", "n")) == [("c", "t0", 3)]
    hits = spark.createDataFrame([("q", "a", 90.0), ("q", "b", 90.0), ("q", "c", 80.0)], "query string, target string, identity double")
    assert rows(graph.neighbours(hits, 1)) == [("q", "b", 90.0)]


def test_nearest_is_exact(spark):
    rng = random.Random(4)
    data = [(i, [rng.randrange(-50, 50) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame([*data, (500, None)], "id long, v array<int>")
    got = graph.nearest(df, "id", "v", F.col("id") % 20 == 0, 4, block=25).collect()
    want = set()
    for q, a in data:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), t) for t, b in data if t != q)[:4]
            want |= {(q, t, -s) for s, t in scored}
    assert {tuple(r) for r in got} == want
    assert graph.nearest(df.limit(0), "id", "v", F.col("id") % 20 == 0, 4).count() == 0


def test_units_and_outgroups(spark, rows):
    g = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "tip int, grp int")
    unit_of = layers.units(g)
    votes = spark.createDataFrame([("s", 1, 2, 0.1), ("s", 1, 3, 0.2), ("s", 2, 3, 0.3)], "shard string, i int, j int, v double")
    assert rows(layers.unit_votes(votes, unit_of)) == [("s", "7", "lone:3", 0.2), ("s", "7", "lone:3", 0.3)]
    hits = spark.createDataFrame([("a", "z"), ("b", "z"), ("a", "b"), ("b", "y")], "query string, target string")
    home = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("z", "c2")], "tip string, component string")
    assert rows(layers.outgroups(hits, home, 1)) == [("c1", "z", 2)]
