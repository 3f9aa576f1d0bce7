import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from grovewise.functions import ids
from grovewise.llm.consolidate import _shuffled, _unshuffled, consolidate, packed_hex, sets_of, unpacked_hex
from grovewise.llm.cooccur import tips_together, together, votes_within


def brute(data, least=1, lift=None):
    out = {}
    scopes = defaultdict(set)
    for s, items in data:
        kept = frozenset(x for x in items or () if x is not None)
        if s is not None and kept:
            scopes[s].add(kept)
    for s, sets in scopes.items():
        one = Counter(x for b in sets for x in b)
        two = Counter(p for b in sets for p in itertools.combinations(sorted(b), 2))
        for (a, b), n in two.items():
            if n >= least and (lift is None or n * len(sets) >= lift * one[a] * one[b]):
                out[s, a, b] = (n, one[a], one[b], len(sets))
    return out


def test_counts_with_huge_baskets_and_dirt(spark):
    rng = random.Random(1)
    data = [(rng.choice("pq"), [f"t{rng.randrange(25):02d}" for _ in range(rng.randrange(1, 9))]) for _ in range(80)]
    data += [("p", [f"t{i:02d}" for i in range(60)]), ("p", [f"t{i:02d}" for i in range(59, -1, -1)]), ("q", []), ("q", None), (None, ["a", "b"]), ("q", [None, "t01", "t01"])]
    df = spark.createDataFrame(data, "scope string, items array<string>").withColumn("basket", F.lit(1)).withColumn("n", F.lit(2))
    for chunk in (5, 64):
        for least, lift in ((1, None), (3, 2)):
            got = {(r["scope"], r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in together(df, "scope", "items", least, lift, chunk).collect()}
            assert got == brute(data, least, lift)


def test_baskets_of_raw_tips(spark):
    rng = random.Random(4)
    hexes = [f"{rng.getrandbits(64):016x}" for _ in range(12)]
    spell = lambda t: rng.choice([t, t.upper(), f" {t}\t", f"{t};size=3", f"{t.upper()};size=12; "])
    for odd in ([], ["x1", "été", "f" * 17]):
        plain = [(rng.choice("pq"), [rng.choice(hexes + odd) for _ in range(rng.randrange(0, 7))]) for _ in range(60)]
        given = [(s, [spell(t) for t in b] + [None, "", " * ", "*;size=1"]) for s, b in plain] + [(None, [hexes[0]]), ("p", None), ("q", [])]
        df = spark.createDataFrame(given, "s string, tips array<string>").withColumn("items", F.lit("clash"))
        got = {(r["s"], r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in tips_together(df, "s", "tips").collect()}
        assert got == brute(plain)
        groups = [(g, t) for g in "AB" for t in rng.sample(hexes + odd, 5)] + [("C", hexes[0])]
        votes = Counter()
        for (_, a, b), (n, *_) in brute(plain).items():
            votes.update({g: n for g in "AB" if (g, a) in groups and (g, b) in groups})
        found = votes_within(df, "s", "tips", spark.createDataFrame(groups * 2, "grp string, tip string"))
        assert {r["grp"]: r["votes"] for r in found.collect()} == votes
        lists = [r[0] for r in ids.tip_lists(df, ["s"], ["tips"]).select("tips").collect()]
        assert lists[:60] == [b for _, b in plain] and lists[60:] == [[hexes[0]], None, []]


def test_empty_baskets(spark):
    assert tips_together(spark.createDataFrame([], "s string, i array<string>"), "s", "i").count() == 0
    assert together(spark.createDataFrame([], "s string, i array<string>"), "s", "i").count() == 0


def test_hash_is_one_to_one(spark):
    keys = [random.Random(2).getrandbits(61) for _ in range(4)]
    values = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(3).getrandbits(64) - 2**63 for _ in range(500))]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", _shuffled(F.col("v"), keys).alias("h"), _unshuffled(_shuffled(F.col("v"), keys), keys).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in got) and len({r["h"] for r in got}) == len(set(values))


def test_packed_hex_keeps_order(spark):
    ids = sorted(["0000000000000000", "7fffffffffffffff", "8000000000000000", "ffffffffffffffff", "b5d7d9e231c4c3ba"])
    df = spark.createDataFrame([(x,) for x in [*ids, "xyz"]], "x string").withColumn("n", packed_hex(F.col("x")))
    got = [r["x"] for r in df.filter("n is not null").orderBy("n").collect()]
    assert got == ids
    assert df.filter("n is not null").filter(unpacked_hex(F.col("n")) != F.col("x")).count() == 0


def components(vertices, edges):
    up = {v: v for v in vertices}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {v: find(v) for v in vertices}


def test_consolidation(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(80)] + [(500, 501 + i) for i in range(50)] + [(i + 1, i) for i in range(5)] + [(7, 7), (700, 700)]
    edges += [(900 + rng.randrange(60), 900 + rng.randrange(60)) for _ in range(45)]
    vertices = sorted({v for e in edges for v in e} | {5000})
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = dict(map(tuple, consolidate(spark.createDataFrame([(v,) for v in vertices] * 2, "v long"), df).collect()))
    assert got == components(vertices, edges)
    assert consolidate(df.select(F.col("a").alias("v")).limit(0), df.limit(0)).count() == 0


def test_sets_of_hex_and_other_ids(spark):
    for name in (lambda i: f"{i:016x}", lambda i: f"id-{i:03d}"):
        rows = [(1, 2, True), (2, 3, True), (4, 5, False), (6, 6, True), (7, None, True), (None, 8, None), (3, 1, None)]
        df = spark.createDataFrame([(a and name(a), b and name(b), k) for a, b, k in rows], "a string, b string, k boolean")
        got = dict(map(tuple, sets_of(df, "a", "b", F.col("k")).collect()))
        assert got == {name(i): name(1 if i <= 3 else i) for i in range(1, 9)}
