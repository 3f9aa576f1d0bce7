import pytest

from grovewise.operators import constraints, lineage, placement


def sets(spark, groups):
    return spark.createDataFrame([(g, i) for g, items in groups.items() for i in items], "grp string, input string")


def test_lineage(spark):
    old = sets(spark, {"A": "abcdef", "B": "ghij", "C": "zy"})
    new = sets(spark, {"a": "abcdefz", "b": "gh", "c": "ij"})
    got = {(r["event"], r["grp"], r["previous"]) for r in lineage.lineage(new, old).collect()}
    assert ("continued", "a", "A") in got
    assert {("born", "b", "B"), ("born", "c", "B"), ("retired", "c", "B")} <= got
    same = lineage.lineage(old, old).collect()
    assert all(r["event"] == "continued" and r["jaccard"] == 1 and r["grp"] == r["previous"] for r in same) and len(same) == 3


def test_minted_ids(spark):
    a = {r["grp"]: r["id"] for r in lineage.minted(sets(spark, {"A": "abc", "B": "abd"})).collect()}
    b = {r["grp"]: r["id"] for r in lineage.minted(sets(spark, {"A": "cbaa", "B": "dba"})).collect()}
    assert a == b and len(set(a.values())) == 2 and all(len(x) == 9 and x[4] == "-" for x in a.values())
    taken = spark.createDataFrame([(a["A"],)], "id string")
    c = {r["grp"]: r["id"] for r in lineage.minted(sets(spark, {"A": "abc"}), taken).collect()}
    assert c["A"] != a["A"]


def test_adjusted_rand(spark):
    score = lambda a, b: lineage.adjusted_rand(spark.createDataFrame(list(zip(a, b)), "a string, b string"), "a", "b").first()[0]
    assert score("000111", "111000") == 1
    assert abs(score("000111", "001122") - (2 - 1.2) / (4.5 - 1.2)) < 1e-9
    assert score("0", "1") == 1


def test_assignment(spark):
    joins = spark.createDataFrame([("q", "a", 0.01), ("q", "b", 0.011), ("q", "c", 0.2), ("far", "a", 0.9)], "query string, member string, height double")
    at = spark.createDataFrame([(0.02, "a", "G1"), (0.02, "b", "G1"), (0.02, "c", "H"), (0.005, "a", "G0")], "level double, member string, grp string")
    got = {r["query"]: (r["level"], r["grp"]) for r in placement.assigned(joins, at).collect()}
    assert got == {"q": (0.02, "G1"), "far": (None, None)}


def test_candidates(spark):
    hits = spark.createDataFrame([("q", "t1", 99.0), ("q", "t2", 99.0), ("r", "t3", 90.0), ("s", "t1", 95.0), ("s", "t3", 95.0), ("u", None, None)], "query string, target string, identity double")
    home = spark.createDataFrame([("t1", "c"), ("t2", "c"), ("t3", "d")], "target string, component string")
    built = spark.createDataFrame([("c",)], "component string")
    got = {r["query"]: (r["candidate"], r["status"]) for r in placement.candidates(hits, home, hits.select("query"), built).collect()}
    assert got == {"q": ("t1", "job"), "r": ("t3", "not_built"), "s": ("t1", "spans_components"), "u": (None, "no_match")}


def test_results_exactly_once(spark):
    plan = spark.createDataFrame([("q", "s1"), ("q", "s2")], "query string, shard string")
    placement.exactly_once(plan, plan, ["query", "shard"])
    for bad in (plan.limit(1), plan.unionAll(plan.limit(1)), plan.unionAll(spark.createDataFrame([("z", "s9")], "query string, shard string"))):
        with pytest.raises(ValueError):
            placement.exactly_once(plan, bad, ["query", "shard"])


def test_constraints(spark):
    ok = spark.createDataFrame([(0, "a", "x"), (1, "a", "X"), (0, "b", None)], "k int, tip string, grp string")
    constraints.nested(ok)
    with pytest.raises(constraints.BadInput):
        constraints.nested(spark.createDataFrame([(0, "a", "x"), (0, "b", "x"), (1, "a", "X"), (1, "b", "Y")], "k int, tip string, grp string"))
    with pytest.raises(constraints.BadInput):
        constraints.unique(ok, ["tip"])
    with pytest.raises(constraints.BadInput):
        constraints.same_rows(ok, ok.limit(1))
