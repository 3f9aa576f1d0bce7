"""Small trees of shards: votes of their pairs, and what they say of groups.

A tree has at most as many leaves as a shard has members (some 200), so each is read within one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.functions.records import rounded
from grovewise.operators.hotkeys import top_per_key

_TOKEN = re.compile(r"[(),;]|[^(),;]+")


def parsed(newick: str) -> tuple[list[int], list[float], list[str]]:
    """Parent, branch length and name of each node; the root comes first."""
    parent, length, name = [-1], [0.0], [""]
    at = 0
    for token in _TOKEN.findall(newick.strip()):
        if token in "(,":
            parent.append(at if token == "(" else parent[at])
            length.append(0.0)
            name.append("")
            at = len(parent) - 1
        elif token == ")":
            at = parent[at]
        elif token != ";":
            label, _, size = token.partition(":")
            name[at], length[at] = label.strip(), float(size or 0)
    return parent, length, name


def _distances(start: int, near: list[list[tuple[int, float]]]) -> tuple[np.ndarray, list[int]]:
    far, before = np.full(len(near), -1.0), [-1] * len(near)
    far[start], todo = 0.0, [start]
    while todo:
        x = todo.pop()
        for y, d in near[x]:
            if far[y] < 0:
                far[y], before[y] = far[x] + d, x
                todo.append(y)
    return far, before


def midpoint(parent: list[int], length: list[float], name: list[str]) -> tuple[list[int], list[float], list[str]]:
    """The tree rooted halfway between its two most distant leaves."""
    near: list[list[tuple[int, float]]] = [[] for _ in parent]
    for x, p in enumerate(parent):
        if p >= 0:
            near[x].append((p, length[x]))
            near[p].append((x, length[x]))
    leaves = [x for x, n in enumerate(near) if len(n) <= 1 and name[x]]
    if len(leaves) < 3:
        return parent, length, name
    first = max(leaves, key=lambda x: (_distances(leaves[0], near)[0][x], -x))
    far, _ = _distances(first, near)
    last = max(leaves, key=lambda x: (far[x], -x))
    to_last, before = _distances(last, near)
    half, x = to_last[first] / 2, first
    while to_last[before[x]] > half:
        x = before[x]
    y = before[x]  # the middle lies between x and y
    root, edge = len(parent), to_last[x] - to_last[y]
    near[x] = [(n, d) for n, d in near[x] if n != y] + [(root, to_last[x] - half)]
    near[y] = [(n, d) for n, d in near[y] if n != x] + [(root, edge - (to_last[x] - half))]
    near.append([(x, to_last[x] - half), (y, edge - (to_last[x] - half))])
    _, up = _distances(root, near)
    order, number = [root], {root: 0}
    for node in order:
        for n, _ in near[node]:
            if n != up[node] and n not in number:
                number[n] = len(order)
                order.append(n)
    size = lambda n: next(d for m, d in near[n] if m == up[n])
    return [number.get(up[n], -1) for n in order], [0.0 if n == root else size(n) for n in order], [name[n] if n < len(name) else "" for n in order]


Tree = tuple[list[int], list[float], list[str]]


def pruned(tree: Tree, keep: set[str]) -> Tree:
    """The tree of some of the leaves; nodes with one branch go, lengths add up."""
    parent, length, name = tree
    alive, inner = [False] * len(parent), set(parent)
    for x in range(len(parent)):
        if name[x] in keep and x not in inner:
            at = x
            while at >= 0 and not alive[at]:
                alive[at], at = True, parent[at]
    branches = [0] * len(parent)
    for x in range(1, len(parent)):
        if alive[x]:
            branches[parent[x]] += 1
    stays = [alive[x] and branches[x] != 1 for x in range(len(parent))]
    children: list[list[int]] = [[] for _ in parent]
    for x in range(1, len(parent)):
        children[parent[x]].append(x)
    out: tuple[list[int], list[float], list[str]] = ([], [], [])
    todo = [(0, -1, 0.0)]
    while todo:
        x, up, far = todo.pop()
        if not alive[x]:
            continue
        if stays[x]:
            out[0].append(up)
            out[1].append(far if up >= 0 else 0.0)
            out[2].append(name[x])
            up, far = len(out[0]) - 1, 0.0
        todo += [(c, up, far + length[c]) for c in children[x]]
    return out


def rooted_on(tree: Tree, outside: set[str], members: list[str]) -> Tree:
    """The tree rooted on the leaf of ``outside`` with the greatest sum of distances to the first 40 members."""
    parent, length, name = tree
    near: list[list[tuple[int, float]]] = [[] for _ in parent]
    for x, p in enumerate(parent):
        if p >= 0:
            near[x].append((p, length[x]))
            near[p].append((x, length[x]))
    leaf = {name[x]: x for x in range(1, len(parent)) if len(near[x]) == 1}
    some = [leaf[m] for m in members if m in leaf][:40]
    candidates = sorted(o for o in outside if o in leaf)
    if not candidates or not some:
        return tree
    far = max(candidates, key=lambda o: sum(_distances(leaf[o], near)[0][m] for m in some))
    start = leaf[far]
    (side, edge), = near[start]
    near[start], near[side] = [(len(parent), edge / 2)], [(n, d) for n, d in near[side] if n != start] + [(len(parent), edge / 2)]
    near.append([(start, edge / 2), (side, edge / 2)])
    out: Tree = ([], [], [])
    todo = [(len(parent), -1, -1, 0.0)]
    while todo:
        x, before, up, d = todo.pop()
        out[0].append(up)
        out[1].append(d)
        out[2].append(name[x] if x < len(name) else "")
        at = len(out[0]) - 1
        todo += [(n, x, at, e) for n, e in near[x] if n != before]
    return out


def collapsed(tree: Tree, least: float) -> Tree:
    """Inner branches below ``least`` go, from the leaves up; their length is added to the branches below."""
    parent, length, name = list(tree[0]), list(tree[1]), tree[2]
    children: list[list[int]] = [[] for _ in parent]
    for x in range(1, len(parent)):
        children[parent[x]].append(x)
    gone = [False] * len(parent)
    for x in _bottom_up(parent):
        if x and children[x] and length[x] < least:
            gone[x] = True
            for c in children[x]:
                parent[c] = parent[x]
                length[c] += length[x]
                children[parent[x]].append(c)
            children[parent[x]].remove(x)
    number = {x: k for k, x in enumerate(x for x in range(len(parent)) if not gone[x])}
    return [number.get(parent[x], -1) for x in number], [length[x] for x in number], [name[x] for x in number]


def _bottom_up(parent: list[int]) -> list[int]:
    children: list[list[int]] = [[] for _ in parent]
    for x in range(1, len(parent)):
        children[parent[x]].append(x)
    order, todo = [], [0]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += children[x]
    return order[::-1]


def written(tree: Tree) -> str:
    """Newick text with branch lengths of 6 significant digits."""
    parent, length, name = tree
    children: list[list[int]] = [[] for _ in parent]
    for x in range(1, len(parent)):
        children[parent[x]].append(x)
    text = [""] * len(parent)
    for x in _bottom_up(parent):
        inner = f"({','.join(text[c] for c in children[x])})" if children[x] else name[x]
        text[x] = inner if parent[x] < 0 else f"{inner}:{length[x]:.6g}"
    return text[0] + ";"


def prepared(newick: str, members: list[str], outside: list[str], width: int, rooting: str = "midpoint") -> str:
    """A shard's tree of its members only, rooted at its midpoint or on its outermost leaf outside, without inner
    branches below half a site (T1)."""
    tree = parsed(newick)
    if rooting == "scaffold":
        tree = rooted_on(tree, set(outside), members)
    tree = pruned(tree, set(members))
    if rooting == "midpoint":
        tree = pruned(midpoint(*tree), set(members))
    return written(collapsed(tree, 0.5 / width))


def prepared_trees(trees: DataFrame, rooting: str = "midpoint") -> DataFrame:
    """``shard``, ``newick``, ``width`` of prepared trees (S16), from ``trees(shard, newick, width, members, outside)``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [prepared(n, list(m), list(o) if o is not None else [], w, rooting) for n, m, o, w in zip(batch["newick"], batch["members"], batch["outside"], batch["width"])]
            yield pd.DataFrame({"shard": batch["shard"], "newick": done, "width": batch["width"]})

    return trees.select("shard", "newick", "width", "members", "outside").mapInPandas(each, "shard string, newick string, width int")


def pooled(trees: DataFrame, twins: DataFrame) -> DataFrame:
    """Trees of both covers, a cover-1 twin of a cover-0 shard once (S17, U6): ``trees(shard, ...)``, ``twins(shard)``."""
    return trees.join(twins.select("shard"), "shard", "left_anti")


def _leaves_below(tree: Tree) -> list[frozenset[str]]:
    parent, _, name = tree
    inner = set(parent)
    below = [frozenset() if x in inner else frozenset([n]) for x, n in enumerate(name)]
    for x in _bottom_up(parent):
        if parent[x] >= 0:
            below[parent[x]] |= below[x]
    return below


def rearranged(stored: str, again: str, query: str, least: float) -> bool:
    """Whether a query's place in a tree made anew has no counterpart in the stored one, both collapsed.

    The place is the set of parts into which the node above the query cuts the other leaves. It has a counterpart
    where a stored node cuts them alike, or, for two parts, where a stored branch does.
    """
    old, new = collapsed(parsed(stored), least), collapsed(parsed(again), least)
    below, fresh = _leaves_below(old), _leaves_below(new)
    everything, whole = below[0], fresh[0]
    at = new[0][next(x for x, n in enumerate(new[2]) if n == query)]
    sides = {fresh[x] for x, p in enumerate(new[0]) if p == at} | ({whole - fresh[at]} if at else set())
    wanted = {(s - {query}) & everything for s in sides} - {frozenset()}
    for x in range(len(old[0])):
        own = {below[c] for c, p in enumerate(old[0]) if p == x} | ({everything - below[x]} if x else set())
        if own == wanted:
            return False
    return not (len(wanted) == 2 and any(below[x] in wanted for x in range(1, len(old[0]))))


def query_joins(newick: str, members: list[str], outside: list[str], query: str, width: int) -> dict[str, float]:
    """The level at which a query joins each member in the prepared tree."""
    found = joins(prepared(newick, [*members, query], outside, width), width, "identical", None)
    return {j if i == query else i: v for i, j, v in found if query in (i, j)}


def placement_results(jobs: DataFrame) -> DataFrame:
    """``query``, ``shard``, ``joins`` and ``moved`` of trees made anew with a query.

    ``jobs(query, shard, newick, stored, width, members, outside)``: the tree with the query, and the stored one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                level = query_joins(r.newick, list(r.members), list(r.outside) if r.outside is not None else [], r.query, r.width)
                rows.append((r.query, r.shard, level, rearranged(r.stored, r.newick, r.query, 0.5 / r.width)))
            yield pd.DataFrame(rows, columns=["query", "shard", "joins", "moved"])

    return jobs.select("query", "shard", "newick", "stored", "width", "members", "outside").mapInPandas(each, "query string, shard string, joins map<string,double>, moved boolean")


def joins(newick: str, width: int, mode: str = "identical", root: str | None = "midpoint") -> list[tuple[str, str, float]]:
    """The level at which each pair of leaves joins.

    Branches inside the tree below half a site are collapsed. A pair joins at its common node's diameter;
    ``identical`` takes the span of the two children instead where that is within one site, ``compatible``
    always takes it, ``patristic`` is the distance of the leaves, ``height`` twice the node's height.
    """
    parent, length, name = parsed(newick)
    if root == "midpoint":
        parent, length, name = pruned(midpoint(parent, length, name), set(name))
    children: list[list[int]] = [[] for _ in parent]
    for x, p in enumerate(parent):
        if p >= 0:
            children[p].append(x)
    order, todo = [], [0]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += children[x]
    length = list(length)
    for x in order:  # from the root down: a collapsed branch's length goes to its children
        for c in list(children[x]):
            stack = [c]
            while stack:
                y = stack.pop()
                if children[y] and length[y] < 0.5 / width:
                    for z in children[y]:
                        length[z] += length[y]
                        stack.append(z)
                    children[x] += children[y]
                    children[x].remove(y)
                    children[y] = []
    reach, span, leaves, found = {}, {}, {}, []
    order, todo = [], [0]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += children[x]
    for x in reversed(order):
        if not children[x]:
            reach[x], span[x], leaves[x] = 0.0, 0.0, {name[x]: 0.0}
            continue
        out = sorted((reach[c] + length[c] for c in children[x]), reverse=True)
        whole = max([*(span[c] for c in children[x]), sum(out[:2])])
        reach[x], span[x] = out[0], whole
        for k, a in enumerate(children[x]):
            for b in children[x][k + 1 :]:
                own = max(span[a], span[b], reach[a] + length[a] + reach[b] + length[b])
                level = {"compatible": own, "identical": own if own <= 1 / width else whole, "height": 2 * out[0], "diameter": whole}.get(mode)
                for i, di in leaves[a].items():
                    for j, dj in leaves[b].items():
                        d = level if level is not None else di + length[a] + dj + length[b]
                        found.append((min(i, j), max(i, j), d))
        leaves[x] = {i: d + length[c] for c in children[x] for i, d in leaves[c].items()}
    return found


def tree_votes(trees: DataFrame, mode: str = "identical", kind: str = "float", root: str | None = "midpoint") -> DataFrame:
    """``trees(shard, newick, width)`` as votes: shard, i, j, v of ``kind`` ``float`` or ``double``."""
    exact = np.float64 if kind == "double" else np.float32

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, newick, width in zip(batch["shard"], batch["newick"], batch["width"]):
                rows = joins(newick, width, mode, root)
                yield pd.DataFrame({"shard": shard, "i": [r[0] for r in rows], "j": [r[1] for r in rows], "v": np.array([r[2] for r in rows], exact)})

    return trees.select("shard", "newick", "width").mapInPandas(votes, f"shard string, i string, j string, v {kind}")


def clades(trees: DataFrame) -> DataFrame:
    """``shard``, ``clade``, ``tip``, ``size``, ``stem`` (in sites) of every inner node but the root."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, newick, width in zip(batch["shard"], batch["newick"], batch["width"]):
                parent, length, name = parsed(newick)
                held: list[list[str]] = [[] for _ in parent]
                inner = set(parent)
                for x, label in enumerate(name):
                    if x not in inner:
                        at = parent[x]
                        while at > 0:
                            held[at].append(label)
                            at = parent[at]
                rows = [(shard, x, tip, len(tips), length[x] * width) for x, tips in enumerate(held) for tip in tips]
                yield pd.DataFrame(rows, columns=["shard", "clade", "tip", "size", "stem"])

    return trees.select("shard", "newick", "width").mapInPandas(members, "shard string, clade int, tip string, size int, stem double")


def verdicts(clade_rows: DataFrame, shard_tips: DataFrame, groups: DataFrame) -> DataFrame:
    """What each shard's tree says of each group of which it holds two tips or more.

    ``whole`` (it holds no other tip), ``clade`` (the held tips are a clade; ``stem``), ``conflict`` (a
    clade has some of them and an outsider, without the others), else ``unresolved``.
    """
    held = shard_tips.join(groups, "tip").groupBy("shard", "grp").agg(F.count(F.lit(1)).alias("held"))
    sizes = shard_tips.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    held = held.filter(F.col("held") >= 2).join(sizes, "shard")
    shared = clade_rows.join(groups, "tip").groupBy("shard", "clade", "size", "stem", "grp").agg(F.count(F.lit(1)).alias("inter"))
    against = shared.join(held, ["shard", "grp"])
    told = against.groupBy("shard", "grp").agg(
        F.max(F.when((F.col("inter") == F.col("held")) & (F.col("size") == F.col("held")), F.col("stem"))).alias("stem"),
        F.max((F.col("inter") < F.col("held")) & (F.col("size") > F.col("inter"))).alias("broken"),
    )
    whole = held.join(told, ["shard", "grp"], "left")
    verdict = F.when(F.col("held") == F.col("n"), "whole").when(F.col("stem").isNotNull(), "clade").when(F.col("broken"), "conflict").otherwise("unresolved")
    outside = (F.col("n") - F.col("held")).alias("outsiders")
    return whole.select("shard", "grp", "held", outside, verdict.alias("verdict"), F.when(verdict == "clade", F.col("stem")).alias("stem"))


def shard_evidence(trees: DataFrame, groups: DataFrame, mode: str = "identical") -> DataFrame:
    """``verdicts`` of prepared trees with each shard's own votes on each group (A21, T3): ``hits`` and ``votes``.

    ``trees(shard, newick, width)``, rooted; ``groups(grp, tip, level)``, where a tip may be in several (nested) groups and
    ``level`` is the one at which a group's joins count. ``votes`` are the pairs of held tips, ``hits`` those that
    join at or below the level. A shard's tips are its tree's leaves; groups of one held tip have no row.
    """
    known = groups.select("grp", "tip", "level").dropna(subset=["grp", "tip"]).dropDuplicates(["grp", "tip"])
    pairs = tree_votes(trees, mode, "double", None)
    tips = pairs.select("shard", F.explode(F.array("i", "j")).alias("tip")).distinct()
    told = verdicts(clades(trees), tips, known.select("grp", "tip"))
    inside = tips.join(known, "tip")
    end = lambda c: inside.select("shard", "grp", F.col("tip").alias(c))
    both = pairs.join(end("i").join(inside.groupBy("shard", "grp").agg(F.max("level").alias("level")), ["shard", "grp"]), ["shard", "i"]).join(end("j"), ["shard", "grp", "j"])
    counts = both.groupBy("shard", "grp").agg(F.count_if(F.col("v") <= F.col("level")).alias("hits"), F.count(F.lit(1)).alias("votes"))
    return told.join(counts, ["shard", "grp"])


def tallied(evidence: DataFrame) -> DataFrame:
    """Verdicts on each group over all shards (A21): grp, shards, n_clade, n_unresolved, n_conflict, n_whole, ``stem`` and ``stem_n``.

    ``stem`` is the median of the clades' branches in sites, both rounded to two decimals; null without a clade."""
    kinds = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("clade", "unresolved", "conflict", "whole")]
    told = evidence.withColumn("stem", rounded(F.col("stem"), 2))
    found = told.groupBy("grp").agg(F.count(F.lit(1)).alias("shards"), *kinds, F.percentile("stem", F.lit(0.5)).alias("stem"), F.count("stem").alias("stem_n"))
    return found.withColumn("stem", rounded(F.col("stem"), 2))


def to_build(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees found by content key in the cache (first wins), and keys still to build, each once."""
    first = top_per_key(cache.filter(F.col("newick").isNotNull()), ["tree_key"], [("shard", "ascending")], 1, ["tree_key", "shard", "newick", "width"])
    reused = inputs.join(first.select("tree_key", "newick", "width"), "tree_key")
    return reused, inputs.join(first, "tree_key", "left_anti").groupBy("tree_key").agg(F.min("shard").alias("shard"))
