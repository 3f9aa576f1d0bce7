"""Preparing trees and comparing places in them, against paths found by brute force."""

import random
from itertools import combinations

import pytest

from grovewise.operators import trees


def grown(rng, names):
    """A random tree, as edges between node numbers with lengths, and its leaves."""
    edges, leaf, ends = {}, {}, []
    for k, n in enumerate(names):
        leaf[n] = k
        ends.append(k)
    new = len(names)
    while len(ends) > 1:
        some = [ends.pop(rng.randrange(len(ends))) for _ in range(min(len(ends), rng.choice([2, 2, 3])))]
        for x in some:
            edges[new, x] = rng.choice([0.0005, 0.002, rng.random() / 10])
        ends.append(new)
        new += 1
    return edges, leaf, ends[0]


def text(edges, leaf, root):
    name = {x: n for n, x in leaf.items()}
    below = [c for (p, c) in edges if p == root]
    return f"({','.join(text_below(edges, name, c) for c in below)});"


def text_below(edges, name, x):
    below = [c for (p, c) in edges if p == x]
    up = next(d for (_, c), d in edges.items() if c == x)
    return (f"({','.join(text_below(edges, name, c) for c in below)})0.9" if below else name[x]) + f":{up!r}"  # inner nodes carry support


def path(edges, a, b):
    """The nodes between two nodes, and the length."""
    near = {}
    for (p, c), d in edges.items():
        near.setdefault(p, {})[c] = d
        near.setdefault(c, {})[p] = d
    todo = [(a, [a], 0.0)]
    while todo:
        x, seen, far = todo.pop()
        if x == b:
            return seen, far
        todo += [(y, [*seen, y], far + d) for y, d in near[x].items() if y not in seen]


def leaf_distances(newick):
    return {tuple(sorted((i, j))): v for i, j, v in trees.joins(newick, 1e12, "patristic", None)}


@pytest.mark.parametrize("seed", range(5))
def test_pruned_and_rooted_trees_keep_distances(seed):
    rng = random.Random(seed)
    names = [f"t{k}" for k in range(11)]
    edges, leaf, root = grown(rng, names)
    newick, members = text(edges, leaf, root), rng.sample(names, 6)
    want = {tuple(sorted(p)): path(edges, leaf[p[0]], leaf[p[1]])[1] for p in combinations(members, 2)}
    outside = [n for n in names if n not in members]
    tree = trees.pruned(trees.parsed(newick), set(members))
    assert sum(p >= 0 for p in tree[0]) <= 2 * len(members) - 2 and sorted(n for x, n in enumerate(tree[2]) if x not in tree[0]) == sorted(members)
    for text_ in (trees.written(tree), trees.written(trees.rooted_on(trees.parsed(newick), set(outside), members))):
        got = leaf_distances(text_)
        assert all(abs(got[p] - d) < 1e-5 for p, d in want.items())
    rooted = trees.rooted_on(trees.parsed(newick), set(outside), members)
    first = [x for x, p in enumerate(rooted[0]) if p == 0]
    far = max(sorted(outside), key=lambda o: sum(path(edges, leaf[o], leaf[m])[1] for m in members))
    assert far in {rooted[2][x] for x in first} and len(first) == 2
    for rooting in ("midpoint", "scaffold"):
        got = leaf_distances(trees.prepared(newick, members, outside, 10**9, rooting))
        assert got.keys() == want.keys() and all(abs(got[p] - d) < 1e-4 for p, d in want.items())
    assert trees.prepared(newick, members[:1], outside, 500).strip("(;)") == members[0]


def place(edges, leaf, query):
    """The parts into which the node beside a leaf cuts the other leaves: together where the path avoids it."""
    (at,) = {p if c == leaf[query] else c for p, c in edges if leaf[query] in (p, c)}
    return at, parts(edges, leaf, at, set(leaf) - {query})


def parts(edges, leaf, at, among):
    out = []
    for n in sorted(among):
        for group in out:
            if at not in path(edges, leaf[n], leaf[group[0]])[0]:
                group.append(n)
                break
        else:
            out.append([n])
    return {frozenset(g) for g in out}


@pytest.mark.parametrize("seed", range(12))
def test_rearranged_places(seed):
    rng = random.Random(seed)
    names = [f"t{k}" for k in range(8)]
    edges, leaf, root = grown(rng, names)
    stored = text(edges, leaf, root)
    (p, c), d = rng.choice(sorted(edges.items()))
    new = max(max(e) for e in edges) + 1
    again = {e: x for e, x in edges.items() if e != (p, c)} | {(p, new): d / 2, (new, c): d / 2, (new, new + 1): 0.01}
    assert not trees.rearranged(stored, text(again, leaf | {"q": new + 1}, root), "q", 0.0)
    mixed = list(names)
    rng.shuffle(mixed)
    other = dict(zip(mixed[:3], [leaf[n] for n in mixed[1:3] + mixed[:1]])) | {n: leaf[n] for n in mixed[3:]} | {"q": new + 1}  # three leaves change places
    _, wanted = place(again, other, "q")
    nodes = {x for e in edges for x in e}
    same = any(parts(edges, leaf, x, {n for n in names if leaf[n] != x}) | ({frozenset([n for n in names if leaf[n] == x])} - {frozenset()}) == wanted for x in nodes if x not in leaf.values())
    split = any(wanted == {frozenset(n for n in names if child in path(edges, root, leaf[n])[0]), frozenset(n for n in names if child not in path(edges, root, leaf[n])[0])} for _, child in edges)
    assert trees.rearranged(stored, text(again, other, root), "q", 0.0) == (not same and not split)


def test_results_of_jobs(spark):
    rng = random.Random(2)
    names = [f"t{k}" for k in range(7)]
    edges, leaf, root = grown(rng, [*names, "q", "o"])
    newick = text(edges, leaf, root)
    stored = trees.written(trees.pruned(trees.parsed(newick), {*names, "o"}))
    df = spark.createDataFrame([("q", "s", newick, stored, 300, names, ["o"])], "query string, shard string, newick string, stored string, width int, members array<string>, outside array<string>")
    (got,) = trees.placement_results(df).collect()
    want = {j if i == "q" else i: v for i, j, v in trees.joins(trees.prepared(newick, [*names, "q"], ["o"], 300), 300, "identical", None) if "q" in (i, j)}
    assert got["joins"] == want and set(want) == set(names) and got["moved"] is False
    done = trees.prepared_trees(spark.createDataFrame([("s", newick, 300, names, None), ("u", newick, 300, names[:3], ["o"])], "shard string, newick string, width int, members array<string>, outside array<string>"))
    assert {r["shard"]: len(leaf_distances(r["newick"])) for r in done.collect()} == {"s": 21, "u": 3}
    assert trees.pooled(done, spark.createDataFrame([("u",)], "shard string")).count() == 1


def test_evidence_of_shards(spark):
    rng = random.Random(5)
    names = [f"t{k}" for k in range(9)]
    shards = {}
    for k in range(4):
        held = rng.sample(names, 7)
        shards[f"s{k}"] = (held, trees.prepared(text(*grown(rng, held)), held, [], 400))
    df = spark.createDataFrame([(s, n, 400) for s, (_, n) in shards.items()], "shard string, newick string, width int")
    groups = {f"g{k}": (rng.sample(names, 2 + k), 0.02 * (k + 1)) for k in range(7)} | {"all": (names, 0.05), "lone": (names[:1], 1.0)}
    rows = [(g, t, level) for g, (tips, level) in groups.items() for t in tips]
    found = trees.shard_evidence(df, spark.createDataFrame([*rows, *rows, ("g1", None, 0.1), (None, "t1", 0.1)], "grp string, tip string, level double"))
    got = {(r["shard"], r["grp"]): r for r in found.collect()}
    want = {}
    for s, (held, newick) in shards.items():
        level_of = {frozenset(p[:2]): p[2] for p in trees.joins(newick, 400, "identical", None)}
        for g, (tips, level) in groups.items():
            both = [frozenset(p) for p in combinations(set(tips) & set(held), 2)]
            if both:
                want[s, g] = (sum(level_of[p] <= level for p in both), len(both), len(set(held) - set(tips)))
    assert {k: (r["hits"], r["votes"], r["outsiders"]) for k, r in got.items()} == want
    for r in trees.tallied(found).collect():
        own = [x for (_, g), x in got.items() if g == r["grp"]]
        stems = sorted(round(x["stem"], 2) for x in own if x["stem"] is not None)
        assert r["shards"] == len(own) and [r[f"n_{v}"] for v in ("clade", "unresolved", "conflict", "whole")] == [sum(x["verdict"] == v for x in own) for v in ("clade", "unresolved", "conflict", "whole")]
        assert r["stem_n"] == len(stems) and (r["stem"] is None) == (not stems)
        if stems:
            assert abs(r["stem"] - (stems[(len(stems) - 1) // 2] + stems[len(stems) // 2]) / 2) <= 0.0051
    assert trees.shard_evidence(df.limit(0), spark.createDataFrame(rows, "grp string, tip string, level double")).count() == 0
