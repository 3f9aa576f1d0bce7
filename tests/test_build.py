"""The composed build, layers on top of it, and what a release asks of them, against plain computations."""

import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from grovewise.operators import build, constraints, layers, linkage, votes


@pytest.fixture(scope="module")
def built(spark):
    """Votes of shards on points of a line in three clumps, in sixteenths."""
    rng = random.Random(3)
    at = {t: (t % 3) * 4 + rng.randrange(16) / 16 for t in range(18)}
    rows = [("s", *sorted(rng.sample(range(18), 2))) for _ in range(700)]
    rows = [(s, i, j, abs(at[i] - at[j]) / 8) for s, i, j in rows if i != j]
    given = spark.createDataFrame(rows, "shard string, i int, j int, v float")
    tips = spark.createDataFrame([(t,) for t in [*range(18), 18]], "tip int")
    return rows, given, tips, build.build(given, tips, [0.05, 0.1, 0.2], floor=0.01, least_stem=0.001, grid=0.0005, top=0.2)


def test_levels_and_tips(built):
    rows, _, _, found = built
    each, groups = found.tips.collect(), found.levels.collect()
    assert len(each) == 19 * 3
    for level in (0.05, 0.1, 0.2):
        of = {r["tip"]: r["grp"] for r in each if r["level"] == level}
        held = defaultdict(set)
        for t, g in of.items():
            if g is not None:
                held[g].add(t)
        own = {r["grp"]: r for r in groups if r["level"] == level}
        assert own.keys() == held.keys() and all(min(s) == g and own[g]["n_tips"] == len(s) for g, s in held.items())
        assert [own[g]["number"] for g in sorted(held, key=lambda g: (-len(held[g]), g))] == list(range(len(held)))
        for g, s in held.items():
            inside = [v for _, i, j, v in rows if i in s and j in s]
            assert own[g]["votes"] == len(inside) and own[g]["cohesion"] == round(sum(v <= level for v in inside) / len(inside), 3)
    assert {r["level"]: r["parent"] for r in groups}[0.2] is None
    parts = {r["tip"]: (r["part"], r["seen"]) for r in found.parts.collect()}
    assert parts[18] == (18, False) and parts[0][1] and len(parts) == 19


def test_stems_are_groups_where_they_are_measured(built):
    _, _, _, found = built
    stems = found.stems.collect()
    assert stems and all(r["height"] <= r["measured_at"] < r["height_top"] and r["votes"] > 0 for r in stems)


def test_layer_in_terms_of_tips(spark, built):
    rows, given, tips, found = built
    fine = found.tips.filter("level = 0.1").select("level", "tip", "grp")
    unit_of = layers.units(fine)
    layer = build.build(layers.unit_votes(given, unit_of), unit_of.select(F.col("unit").alias("tip")), [0.3, 0.6, 1.5], least_votes=2)
    cuts, groups, each = build.appended(fine, unit_of, layer, top=0.6)
    units = {r["tip"]: r["unit"] for r in unit_of.collect()}
    joint = {(r["level"], r["tip"]): r["grp"] for r in layer.tips.collect()}
    got = {(r["level"], r["tip"]): r["grp"] for r in cuts.collect()}
    assert {x for x, _ in got} == {0.1, 0.3, 0.6}
    want = {}
    for x in (0.3, 0.6):
        held = defaultdict(set)
        for t, u in units.items():
            held[("group", joint[x, u]) if joint[x, u] is not None else ("unit", u)].add(t)
        for s in held.values():
            want |= {(x, t): min(s) if len(s) > 1 else None for t in s}
    assert {k: g for k, g in got.items() if k[0] > 0.1} == want
    sizes = defaultdict(int)
    for (x, _), g in want.items():
        sizes[x, g] += g is not None
    assert {(r["level"], r["grp"]): r["n_tips"] for r in groups.collect()} == {k: n for k, n in sizes.items() if n}
    assert {r["level"] for r in each.collect()} == {0.3, 0.6}
    far = {(r["level"], r["grp"]): (r["spread"], r["spread_median"]) for r in build.coarse_spread(spark.createDataFrame([(i, j, v) for _, i, j, v in rows], "i int, j int, d double"), cuts.filter("level > 0.1")).collect()}
    for (x, g), (most, mid) in far.items():
        inside = [v for _, i, j, v in rows if want[x, i] == want[x, j] == g]
        assert (most, mid) == (max(inside), median(inside))
    top = fine.filter(F.col("grp").isNotNull()).groupBy("grp").agg(F.count(F.lit(1)).alias("n_tips"))
    sizes_fine = {r["grp"]: r["n_tips"] for r in top.collect()}
    for r in build.continuing(top, cuts.filter("level > 0.1")).collect():
        alone = [x for x in (0.3, 0.6) if sizes[x, want[x, r["grp"]]] == sizes_fine[r["grp"]]]
        above = [want[x, r["grp"]] for x in (0.3, 0.6) if x not in alone]
        assert (r["continues"], r["parent"]) == (max(alone, default=None), above[0] if above else None)


def test_same_sets(spark):
    rng = random.Random(5)
    sets = {f"a{k}": frozenset(rng.sample(range(5), rng.randrange(1, 4))) for k in range(12)}
    other = {f"b{k}": frozenset(rng.sample(range(5), rng.randrange(1, 4))) for k in range(12)}
    table = lambda d: spark.createDataFrame([(k, m) for k, s in d.items() for m in s] + [(None, 1), ("z", None)], "name string, member int")
    assert {tuple(r) for r in build.same_sets(table(sets), table(other)).collect()} == {(a, b) for a, s in sets.items() for b, t in other.items() if s == t}


def test_units_of_components(spark):
    top = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", None)], "tip string, grp string")
    home = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "tip string, component string")
    units = lambda *u: spark.createDataFrame(list(zip("abc", u)), "tip string, unit int")
    constraints.single_units(top, units(1, 1, 2), home)
    for bad in (units(1, 2, 3), units(1, 1, 1), units(1, 1, 2).limit(2)):
        with pytest.raises(constraints.BadInput):
            constraints.single_units(top, bad, home)
    with pytest.raises(constraints.BadInput):
        constraints.single_units(top, units(1, 1, 2), home.withColumn("component", F.col("tip")))


def test_stale_products_are_refused(spark):
    kind = "product string, key string, tips array<string>"
    have = spark.createDataFrame([("p", "k", ["a", "b"]), ("q", None, None)], kind)
    want = lambda *rows: spark.createDataFrame(list(rows), kind)
    assert [r["product"] for r in constraints.fresh(have, want(("p", "k", ["a", "b"]), ("new", "k", None))).collect()] == ["new"]
    assert constraints.fresh(have, want(("p", "k", None))).count() == 0
    for bad in (("p", "other", None), ("p", "k", ["a"]), ("q", "k", None)):
        with pytest.raises(constraints.BadInput):
            constraints.fresh(have, want(bad))


def test_nothing_to_build(spark):
    none = spark.createDataFrame([], "shard string, i int, j int, v float")
    found = build.build(none, spark.createDataFrame([(1,), (2,)], "tip int"), [0.1])
    assert found.levels.count() == found.nodes.count() == found.stems.count() == 0
    assert {(r["tip"], r["part"], r["seen"]) for r in found.parts.collect()} == {(1, 1, False), (2, 2, False)}


def test_only_the_tables_asked_for_are_made(spark, monkeypatch):
    given = spark.createDataFrame([(s, i, j, 0.04) for s in range(2) for i, j in ((1, 2), (1, 3), (2, 3))], "shard int, i int, j int, v float")
    asked = []
    monkeypatch.setattr(linkage, "stem_nodes", lambda *_: asked.append("stems"))
    monkeypatch.setattr(votes, "separation", lambda *_: asked.append("nodes"))
    found = build.build(given, spark.createDataFrame([(t,) for t in range(1, 5)], "tip int"), [0.05])
    assert [(r["grp"], r["n_tips"]) for r in found.levels.collect()] == [(1, 3)] and not asked
