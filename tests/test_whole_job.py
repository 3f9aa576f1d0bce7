"""Queries over small tables with the rows that are easily lost."""

import itertools
import math
import random

import pytest

from grovewise.operators import graph, placement
from grovewise.plans import grouping_queries as gq

KNN = [("a1", "a2", 0.95), ("A2;size=3", "a3", 90.0), ("a1", "b1", 80.0), ("b1", "b2", 99.0), ("lone", "a1", 70.0), ("q", "lone", 85.0), ("q", "a3", 84.0), ("none", "*", None), ("me", "me", 100.0)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(KNN, "query string, target string, identity double").write.parquet(f"{at}/knn.parquet")
    shards = [("p", "c", 0, "s1", ["a1", "A2", "shard-only"], None), ("p", "c", 1, "s2", ["a1", "a3"], None), ("p", "c", 1, "s3", ["a1"], ["b1"])]
    spark.createDataFrame(shards, "plan_id string, component string, cover int, shard string, members array<string>, context array<string>").write.parquet(f"{at}/manifest.parquet")
    return at


def test_components_of_lone_vertices(spark, rows):
    edges = spark.createDataFrame([("b", "c"), ("d", "c")], "a string, b string")
    vertices = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "v string")
    assert rows(graph.components(edges, vertices=vertices)) == [("a", "a"), ("b", "b"), ("c", "b"), ("d", "b"), ("z", "z")]


def test_lone_tips_have_anchors_and_outgroups(spark, tables, rows):
    assert rows(gq.component_anchors(spark, tables).select("component", "n_tips")) == [("a1", 3), ("b1", 2), ("lone", 1), ("me", 1), ("none", 1), ("q", 1)]
    assert rows(gq.outgroups_top8(spark, tables)) == [("a1", "b1", 1), ("lone", "a1", 1), ("q", "a3", 1), ("q", "lone", 1)]


def test_best_hit_may_be_a_lone_tip(spark, tables):
    got = {r["query"]: (r["candidate"], r["component"], r["status"]) for r in gq.candidate_status(spark, tables).collect()}
    assert got["q"] == ("lone", "lone", "not_built") and got["lone"] == ("a1", "a1", "job") and got["none"] == (None, None, "no_match")
    assert {r["status"]: r["n"] for r in gq.status_counts(spark, tables).collect()} == {"job": 3, "not_built": 2, "no_match": 2}


def test_targets_without_component_count(spark):
    hits = spark.createDataFrame([("q", "t", 80.0), ("q", "x", 90.0), ("r", "t", 90.0), ("r", "x", 90.0)], "query string, target string, identity double")
    home, built = spark.createDataFrame([("t", "c")], "target string, component string"), spark.createDataFrame([("c",)], "component string")
    got = {r["query"]: (r["candidate"], r["status"]) for r in placement.candidates(hits, home, hits.select("query"), built).collect()}
    assert got == {"q": ("x", "not_built"), "r": ("t", "spans_components")}


def test_account_holds_every_tip(spark, tables):
    got = {r["tip"]: (r["n_shards"], r["status"]) for r in gq.coverage_account(spark, tables).collect()}
    assert set(got) == {"a1", "a2", "a3", "b1", "b2", "lone", "q", "none", "me", "shard-only"}
    assert got["a1"] == (3, "covered") and got["none"] == got["me"] == (0, "isolated") and got["shard-only"] == (1, "under")


def test_nearest_of_the_given_values(spark, tmp_path, rows):
    rng = random.Random(5)
    data = [(i, [rng.gauss(0, 0.001) + (j == 0) for j in range(16)]) for i in range(80)]
    data.append((80, data[7][1]))
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    given = {r[0]: r[1] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    want = []
    for q in range(0, 81, 20):
        scores = sorted((-math.fsum(x * y for x, y in zip(given[q], given[t])), t) for t in given if t != q)[:10]
        want += [(q, t, -s) for s, t in scores]
    assert rows(gq.vector_neighbours(spark, str(tmp_path))) == sorted(want)
    df = spark.createDataFrame(list(given.items()), "vec_id long, v array<double>")
    assert rows(graph.nearest(df, "vec_id", "v", df.vec_id % 20 == 0, 10, block=9)) == sorted(want)


def test_every_pair_of_units_is_planned(spark, tmp_path):
    groups = [(f"G{i:03d}", "c") for i in range(200)]
    spark.createDataFrame(groups, "group_id string, component string").write.parquet(f"{tmp_path}/groups.parquet")
    members = spark.createDataFrame([(g, f"{g}-{t}") for g, _ in groups for t in range(3)], "group_id string, tip_id string")
    members.write.parquet(f"{tmp_path}/group_members.parquet")
    held = {}
    for r in gq.sparse_plan(spark, str(tmp_path)).collect():
        assert r["tip"].startswith(f"{r['unit'].lower()}-") and r["unit"] not in held.setdefault(r["shard"], {})
        held[r["shard"]][r["unit"]] = r["tip"]
    assert len(held) == math.ceil(24 / (150 / 200 * 149 / 199)) and {len(x) for x in held.values()} == {150}
    votes = {}
    for shard in held.values():
        for pair in itertools.combinations(sorted(shard), 2):
            votes[pair] = votes.get(pair, 0) + 1
    assert len(votes) == 200 * 199 // 2 and min(votes.values()) >= 3
    assert len({t for x in held.values() for t in x.values()}) == 600
