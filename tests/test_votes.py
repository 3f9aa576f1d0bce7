"""Evidence of groups against a plain computation over random votes."""

import random
from collections import defaultdict
from itertools import combinations
from statistics import median

import pytest
from py4j.protocol import Py4JJavaError

from grovewise.operators import numbering, votes

LEVELS = [0.1, 0.3]


def drawn(seed, tips=14, groups=4):
    """Votes on random pairs in eighths (exact in FLOAT), and a random grouping for each level; 9 tips or more in groups."""
    rng = random.Random(seed)
    rows = [(*sorted(rng.sample(range(tips), 2)), rng.randrange(7) / 8) for _ in range(160)]
    group_of = {(x, t): rng.choice([None, *range(9, 9 + groups)] if t > 3 else [9, 10]) for x in LEVELS for t in range(tips)}
    return rows, group_of


def pooled(rows, x):
    """(hits, votes) of each pair at a level."""
    by = defaultdict(list)
    for i, j, v in rows:
        by[i, j].append(v)
    return {p: (sum(v <= x for v in vs), len(vs)) for p, vs in by.items()}


def tables(spark, rows, group_of):
    given = spark.createDataFrame(rows, "i int, j int, v float").repartition(3)
    groups = spark.createDataFrame([(x, t, g) for (x, t), g in group_of.items()], "level double, tip int, grp int")
    return votes.consensus(given, LEVELS), groups


@pytest.mark.parametrize("seed", [1, 2])
def test_consensus(spark, seed):
    rows, group_of = drawn(seed)
    found = tables(spark, rows, group_of)[0].collect()
    by = defaultdict(list)
    for i, j, v in rows:
        by[i, j].append(v)
    assert {(r["i"], r["j"]): (r["med"], r["votes"], r["hits"]) for r in found} == {p: (median(v), len(v), [sum(x <= y for x in v) for y in LEVELS]) for p, v in by.items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_evidence(spark, seed):
    rows, group_of = drawn(seed)
    pairs, groups = tables(spark, rows, group_of)
    grouped = votes.with_groups(votes.at_levels(pairs, LEVELS), groups)
    member, inner, pull, group_pull = {}, {}, {}, {}
    for x in LEVELS:
        of = {t: g for (y, t), g in group_of.items() if y == x}
        seen = pooled(rows, x)
        own = defaultdict(lambda: [0, 0, 0])
        whole = defaultdict(lambda: [0, 0, 0])
        outside = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for (i, j), (h, v) in seen.items():
            same = of[i] is not None and of[i] == of[j]
            for a, b in ((i, j), (j, i)):
                target = (0, of[b]) if of[b] is not None else (1, b)
                cell = own[a] if same else outside[a][target]
                for k, n in enumerate((h, v, 1)):
                    cell[k] += n
            if same:
                for k, n in enumerate((h, v, 1)):
                    whole[of[i]][k] += n
        member |= {(x, t): (h / v, v, n) for t, (h, v, n) in own.items()}
        sizes = {g: sum(y == g for y in of.values()) for g in of.values() if g is not None}
        inner |= {(x, g): (whole[g][0] / whole[g][1] if whole[g][1] else None, *whole[g][1:], whole[g][2] / (n * (n - 1) / 2)) for g, n in sizes.items() if n > 1}
        for t, targets in outside.items():
            best = min(targets, key=lambda k: (-targets[k][0] / targets[k][1], -targets[k][1], k))
            h, v, n = targets[best]
            every = [sum(c[k] for c in targets.values()) for k in range(3)]
            pull[x, t] = (h / v, ("group", "tip")[best[0]], str(best[1]), h, v, n) if h else (0.0, "nothing_joins", None, 0, *every[1:])
        for g in sizes:
            got = [pull[x, t][3:5] for t, y in of.items() if y == g and (x, t) in pull]
            if got:
                group_pull[x, g] = sum(h for h, _ in got) / sum(v for _, v in got)
    assert {(r["level"], r["tip"]): (r["membership"], r["votes"], r["partners"]) for r in votes.membership(grouped).collect()} == member
    assert {(r["level"], r["grp"]): (r["cohesion"], r["votes"], r["pairs"], r["held"]) for r in votes.cohesion(grouped, groups).collect()} == inner
    pulls = votes.tip_pull(grouped)
    assert {(r["level"], r["tip"]): (r["pull"], r["target_kind"], r["target"], r["hits"], r["votes"], r["partners"]) for r in pulls.collect()} == pull
    assert {(r["level"], r["grp"]): r["pull"] for r in votes.group_pull(pulls).collect()} == group_pull


def test_numbers_break_ties_as_numbers(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5, 1, 2), (1, 3, 0.5, 1, 2)], "i int, j int, level double, hits long, votes long")
    groups = spark.createDataFrame([(0.5, 1, 4), (0.5, 2, 10), (0.5, 3, 9)], "level double, tip int, grp int")
    best = {r["tip"]: r["target"] for r in votes.tip_pull(votes.with_groups(pairs, groups)).collect()}
    assert best == {1: "9", 2: "4", 3: "4"}


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_separation(spark, seed):
    rng = random.Random(seed)
    of = {t: rng.choice([None, 20, 3, 11]) for t in range(15)}
    d = {p: rng.randrange(1, 6) / 4 for p in combinations(range(15), 2) if rng.random() < 0.6}
    pairs = spark.createDataFrame([(i, j, x) for (i, j), x in d.items()], "i int, j int, d double").repartition(3)
    got = votes.separation(pairs, spark.createDataFrame(list(of.items()), "tip int, grp int")).collect()
    assert {r["grp"] for r in got} == set(of.values()) - {None}
    for r in got:
        g = r["grp"]
        inside = [x for (i, j), x in d.items() if of[i] == of[j] == g]
        across = sorted((x, b) for (i, j), x in d.items() for a, b in ((i, j), (j, i)) if of[a] == g != of[b])
        assert (r["spread"], r["spread_median"], r["pairs"]) == ((max(inside), median(inside), len(inside)) if inside else (None, None, 0))
        relatives = {}
        for x, b in across:
            if of[b] is not None:
                relatives.setdefault(of[b], (x, b))
        near = [(*v, k) for k, v in sorted(relatives.items(), key=lambda kv: kv[1])[:2]] + [(None,) * 3] * 2
        assert (r["nearest_distance"], r["nearest_tip"], r["nearest"]) == near[0] and (r["second_distance"], r["second_tip"], r["second"]) == near[1]
        loose = [(x, b) for x, b in across if of[b] is None]
        assert (r["stray_distance"], r["stray"]) == (loose[0] if loose else (None, None))
        assert r["strays_closer"] == len({b for x, b in loose if near[0][0] is None or x < near[0][0]})


def test_numbering(spark):
    rng = random.Random(9)
    values = [(rng.randrange(40), k, "x") for k in range(300)]
    df = spark.createDataFrame(values, "a int, b int, place_of string").repartition(7)
    got = sorted((r["place"], r["a"], r["b"]) for r in numbering.numbered(df, ["a", "b"], descending=("a",)).collect())
    assert got == [(k, a, b) for k, (a, b, _) in enumerate(sorted(values, key=lambda v: (-v[0], v[1])))]
    assert numbering.numbered(df.limit(0), ["a"]).count() == 0
    of = spark.createDataFrame([(0.1, t, g) for t, g in ((1, "b"), (2, "a"), (3, "b"), (4, None), (5, "c"), (0, "c"))] + [(0.2, 1, "z")], "level double, tip int, grp string")
    assert {(r["level"], r["grp"]): r["number"] for r in numbering.groups_by_size(of).collect()} == {(0.1, "c"): 0, (0.1, "b"): 1, (0.1, "a"): 2, (0.2, "z"): 0}


def test_empty(spark):
    empty = spark.createDataFrame([], "i int, j int, v float")
    assert votes.consensus(empty, [0.1]).count() == 0


def test_medians_without_states_of_pairs(spark):
    rng = random.Random(7)
    rows = [(0, 1, rng.randrange(9) / 8) for _ in range(5000)] + [(1, 2, None), (1, 2, 0.5), (1, 2, 0.25), (2, 3, None)]  # one pair holds most
    found = votes.consensus(spark.createDataFrame(rows, "i int, j int, v float").repartition(3), [0.25])
    hot = [r[2] for r in rows[:5000]]
    assert {(r["i"], r["j"]): (r["med"], r["votes"], r["hits"]) for r in found.collect()} == {(0, 1): (median(hot), 5000, [sum(x <= 0.25 for x in hot)]), (1, 2): (0.375, 3, [1]), (2, 3): (None, 1, [0])}
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()


def test_medians_of_runs_of_rows(spark):
    rng = random.Random(8)
    rows = [(str(i), str(i + 1), None if rng.random() < 0.2 else rng.randrange(9) / 8) for i in range(40) for _ in range(rng.choice((1, 2, 3, 40)))]
    rows += [("x", None, 0.5), (None, "x", 0.25), (None, None, None), ("x", None, 1.0)]
    given = spark.createDataFrame(rows, "i string, j string, v float")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # pairs go on over several batches
    try:
        found = votes.consensus(given, [0.25, 0.5])
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["i"], r["j"]): (r["med"], r["votes"], r["hits"]) for r in found.collect()}
        assert votes.consensus(given, []).count() == len(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, j, _ in rows:
        every = [v for a, b, v in rows if (a, b) == (i, j)]
        v = sorted(x for x in every if x is not None)
        want[i, j] = ((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None, len(every), [sum(x <= level for x in v) for level in (0.25, 0.5)])
    assert got == want


@pytest.mark.parametrize("tip, shard, held, far", [("int", "int", 1_000_000, 1), ("bigint", "string", 50, 2**40), ("string", "int", 1_000_000, 1), ("smallint", "bigint", 7, 1)])
def test_medians_of_shards(spark, monkeypatch, tip, shard, held, far):
    monkeypatch.setattr(votes, "HELD", held)
    rng = random.Random(7)
    odd = [None, float("nan"), -0.0, float("inf"), float("-inf")]
    given = [(rng.randrange(40) if rng.random() > 0.02 else None, (rng.randrange(-9, 10) if rng.random() > 0.02 else None), rng.choice(odd) if rng.random() < 0.1 else rng.randrange(7) / 8) for _ in range(700)]
    rows = spark.createDataFrame([(s, t and t * far, x) for s, t, x in given], "s int, t bigint, x double").selectExpr(f"cast(s as {shard}) s", f"cast(t as {tip}) t", "x").repartition(3)
    got = votes.shard_medians(rows, "s", "t", "x")
    assert got.schema["i"].dataType.simpleString() == tip
    least = rows.groupBy("s", "t").agg({"x": "min"}).withColumnRenamed("min(x)", "x")
    want = votes.consensus(votes.pair_votes(least, "s", "t", "x"), []).drop("hits")
    plain = lambda df: sorted((r["i"], r["j"], str(r["med"]), r["votes"]) for r in df.collect())
    assert plain(got) == plain(want) and len(plain(got)) > 100
    assert votes.shard_medians(rows.limit(0), "s", "t", "x").count() == 0


@pytest.mark.parametrize("name", ["forest_parts", "stem_nodes", "numbered_groups", "enclosing_groups"])
def test_votes_of_a_linkage_are_no_rows(spark, tmp_path, name):
    """The linkage shuffled a row for each vote: 40 shards of 40 tips have 31,200."""
    from grovewise.plans import grouping_queries

    rng = random.Random(3)
    spark.createDataFrame([(s, t, rng.randrange(9) / 100) for s in range(40) for t in range(40)], "l_orderkey bigint, l_suppkey bigint, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(45).selectExpr("id s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    context = spark.sparkContext._jsc.sc()
    first = context.dagScheduler().nextStageId()
    found = sorted(map(tuple, grouping_queries.QUERIES[name](spark, str(tmp_path)).collect()))
    if name == "forest_parts":
        assert found == [(0, 40), *((t, 1) for t in range(40, 45))]
    context.listenerBus().waitUntilEmpty(30_000)
    shuffled = 0
    for k in range(first, context.dagScheduler().nextStageId()):
        try:
            shuffled += context.statusStore().lastStageAttempt(k).shuffleWriteRecords()
        except Py4JJavaError:  # a stage that was not run
            continue
    assert 1_600 < shuffled < 20_000


def test_hits_and_groups_of_blocks_as_of_rows(spark):
    rng = random.Random(21)
    given = [(s, t * far, None if rng.random() < 0.1 else rng.randrange(8) / 64) for s in range(40) for t, far in ((rng.randrange(9), rng.choice([1, 2**40])) for _ in range(6))]
    levels = [0.0, 1 / 32, 0.05]
    groups = [(x, t * far, None if t % 3 == 0 else t % 2) for x in levels for t in range(8) for far in (1, 2**40) if (t, far) != (0, 1)]
    group_of = spark.createDataFrame(groups, "level double, tip bigint, grp int")
    for some in (given, [g for g in given if g[1] < 9]):
        df = spark.createDataFrame(some, "shard int, tip bigint, x double")
        least = df.groupBy("shard", "tip").agg({"x": "min"}).toDF("shard", "tip", "x")
        rows = votes.consensus(votes.pair_votes(least, "shard", "tip", "x"), levels)
        blocks = votes.shard_medians(df, "shard", "tip", "x", levels)
        key = lambda d: sorted((r["i"], r["j"], r["med"] if r["med"] is not None else -1, r["votes"], tuple(r["hits"])) for r in d.collect())
        assert key(blocks) == key(rows)
    want, got = votes.with_groups(votes.at_levels(rows, levels), group_of), votes.leveled_with_groups(blocks, levels, group_of)
    order = sorted(want.columns)
    assert sorted(got.columns) == order and sorted(map(repr, want.select(order).collect())) == sorted(map(repr, got.select(order).collect()))
