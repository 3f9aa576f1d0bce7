"""Parent-child links of unknown depth: root, depth, full path, descendants, cycles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovewise.storage import Scratch

#: State of a link: its top has a parent of its own that isn't known here; its top is a root; its top is
#: the smallest node of a cycle.
OPEN, ROOT, CYCLE = 0, 1, 2


def _solve(block: pd.DataFrame, with_path: bool) -> pd.DataFrame:
    """Weighted disjoint-set forest over one block of links (node, top, off, lo, state[, via]).

    A link says that ``top`` lies ``off`` steps above ``node``; ``lo`` is the smallest node on the way,
    ``top`` not included. Compression joins links until the top is no node of the block, or is final;
    offsets add up, minima merge. What never ends runs into a cycle of the block.
    """
    if block.empty:
        return block
    node, top = block["node"].to_numpy(object), block["top"].to_numpy(object).copy()
    off, lo = block["off"].to_numpy(np.int64).copy(), block["lo"].to_numpy(object).copy()
    state = block["state"].to_numpy(np.int32).copy()
    index = pd.Index(node)
    up = index.get_indexer(pd.Index(top))
    up[state != OPEN] = -1
    direct = up.copy()
    for _ in range(int(len(node)).bit_length() + 1):
        on = np.flatnonzero(up >= 0)
        if not len(on):
            break
        over = up[on]
        new = (top[over], off[on] + off[over], np.minimum(lo[on], lo[over]), state[over], up[over])
        top[on], off[on], lo[on], state[on], up[on] = new
    round_ = np.flatnonzero(up >= 0)
    if len(round_):
        on_cycle = np.unique(up[round_])  # after as many steps as there are nodes, every walk is on its cycle
        least = dict(zip(on_cycle.tolist(), lo[on_cycle]))
        name = np.array([least[x] for x in up[round_].tolist()], dtype=object)
        top[round_], lo[round_], state[round_], off[round_] = name, name, CYCLE, -1
    out = {"node": node, "top": top, "off": off, "lo": lo, "state": state}
    if with_path:
        via, final = block["via"].tolist(), [None] * len(node)
        for i in range(len(node)):  # each node's way, by the index of parents
            way, at = [], i
            while at >= 0 and state[i] != CYCLE:
                way.append(via[at])
                at = direct[at]
            final[i] = [x for part in way for x in part]
        out["via"] = final
    return pd.DataFrame(out)


def _solver(with_path: bool):
    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield _solve(pd.concat(held, ignore_index=True), with_path)

    return partition


def hierarchy(
    links: DataFrame, node: str, parent: str, with_path: bool = False,
    block_rows: int = 100_000, least_blocks: int = 16, scratch: Scratch | None = None,
) -> DataFrame:
    """Root and depth of every node; with ``with_path`` also the path from the root to the node.

    ``links`` has one row for each node. A node whose parent is null or no node of the table is a root.
    Result: the node's column, ``root_id``, ``depth`` and perhaps ``path`` (array, root first). For a node
    on a cycle, or below one, ``depth`` is -1, ``root_id`` the smallest node on the cycle and ``path`` null;
    with ``with_path`` such a node also shows its parent as ``up`` (null elsewhere), for ``descendants``.
    Rows with a null node are left out; repeated rows of a node count once (the greatest parent wins).

    Method: links lie in blocks by the leading bits of a hash of the node, at most about ``block_rows`` to a
    block, and in ``least_blocks`` or more unless there are fewer than a few hundred links for each. Every
    block resolves what lies within it as a weighted disjoint-set forest with offsets to its roots, then
    neighbouring blocks merge, four to one, and the links that crossed between them resolve, until one block
    is left. So that a merged block stays within ``block_rows`` however large the table, each round first
    takes out of it what the others don't need: nodes that nobody points to are set aside (rake), and links
    are joined over tops that are final or that a fresh hash picks (compress), which shrinks the rest by a
    constant share whatever the depth. Blocks whose links don't yet fit into one wait with merging.
    Nodes set aside are then resolved through the tops they point to, latest first. Every round is a
    table in the shared folder; no block depends on the size of a tree.
    """
    spark = links.sparkSession
    scratch = scratch or Scratch(spark)
    kind = links.schema[node].dataType
    given = links.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.max(F.col(parent).cast(kind)).alias("top"))
    given = scratch.keep(given)
    known = given.select(F.col("node").alias("top"), F.lit(True).alias("is_node"))
    given = scratch.keep(given.join(known, "top", "left").select("node", F.when(F.col("is_node"), F.col("top")).alias("top")))
    fields = [T.StructField("node", kind), T.StructField("top", kind), T.StructField("off", T.LongType()), T.StructField("lo", kind), T.StructField("state", T.IntegerType())]
    columns = [F.col("node"), F.col("top"), F.lit(1).cast("long").alias("off"), F.col("node").alias("lo"), F.lit(OPEN).alias("state")]
    if with_path:
        fields.append(T.StructField("via", T.ArrayType(kind)))
        columns.append(F.array("node").alias("via"))
    schema = T.StructType(fields)
    roots = given.filter(F.col("top").isNull()).select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *([F.array("node").alias("path")] if with_path else []))
    rest = given.filter(F.col("top").isNotNull()).select(*columns)
    left = rest.count()

    aside: list[DataFrame] = []  # links of each round's nodes, to be resolved through their tops
    carry = ["via"] if with_path else []
    round_, held = 0, None
    fits = lambda rows: max(0, math.ceil(math.log2(max(1, rows) / block_rows)))
    bits = max(fits(left), math.ceil(math.log2(max(1, min(least_blocks, left / 250)))))
    while left:
        round_ += 1
        block = F.shiftrightunsigned(F.xxhash64("node"), 64 - bits).cast("int") if bits else F.lit(0)
        solved = scratch.keep(rest.repartitionById(1 << bits, block).mapInPandas(_solver(with_path), schema))
        if held is not None:
            scratch.drop(held)
        if not bits:
            # what is still open points to a root: no node of this block is left above it
            aside.append(solved.withColumn("state", F.when(F.col("state") == OPEN, ROOT).otherwise(F.col("state"))))
            break
        # rake: only tops of open links stay
        tops = solved.filter(F.col("state") == OPEN).select(F.col("top").alias("node")).distinct().withColumn("is_top", F.lit(True))
        marked = scratch.keep(solved.join(tops, "node", "left"))
        scratch.drop(solved)
        aside.append(marked.filter(F.col("is_top").isNull()).drop("is_top"))
        inner = marked.filter(F.col("is_top")).drop("is_top")
        # compress: links pass over tops that are final or picked by this round's coin
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(-round_)), F.lit(2)) == 1
        above = inner.select(
            F.col("node").alias("top"), F.col("top").alias("a_top"), F.col("off").alias("a_off"), F.col("lo").alias("a_lo"),
            F.col("state").alias("a_state"), *(F.col(c).alias(f"a_{c}") for c in carry), (coin("node") & ~coin("top")).alias("picked"),
        )
        is_open = F.col("state") == OPEN
        joined = inner.filter(is_open).join(above, "top", "left")
        over = F.coalesce((F.col("a_state") != OPEN) | F.col("picked"), F.lit(False))
        # a top without a link is a root; a link that comes back to its own node closes a cycle
        moved = joined.select(
            "node", F.when(over, F.col("a_top")).otherwise(F.col("top")).alias("top"),
            F.when(over, F.col("off") + F.col("a_off")).otherwise(F.col("off")).alias("off"),
            F.when(over, F.least("lo", "a_lo")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("a_state").isNull(), ROOT).when(over, F.col("a_state")).otherwise(OPEN).cast("int").alias("state"),
            *(F.when(over, F.concat(c, f"a_{c}")).otherwise(F.col(c)).alias(c) for c in carry),
        )
        loop = is_open & (F.col("top") == F.col("node"))
        closed = moved.select(
            "node", F.when(loop, F.col("lo")).otherwise(F.col("top")).alias("top"), "off", "lo",
            F.when(loop, CYCLE).otherwise(F.col("state")).cast("int").alias("state"), *carry,
        )
        rest = held = scratch.keep(closed.unionByName(inner.filter(~is_open)))
        left = rest.count()
        bits = min(bits, max(fits(left), bits - 2))  # neighbours merge where they fit

    final = [F.col("node"), F.col("top").alias("root"), F.when(F.col("state") == CYCLE, F.lit(-1).cast("long")).otherwise(F.col("off")).alias("depth")]
    if with_path:
        final.append(F.when(F.col("state") == ROOT, F.concat(F.array("top"), F.reverse("via"))).alias("path"))
    done: DataFrame | None = None
    for part in reversed(aside):
        ready = part.filter(F.col("state") != OPEN).select(*final)
        known = [ready]
        if done is not None:
            above = done.select(F.col("node").alias("top"), "root", "depth", *(["path"] if with_path else []))
            through = part.filter(F.col("state") == OPEN).join(above, "top", "left")
            lost = F.col("root").isNull()  # its top has no link: a root
            cyclic = F.col("depth") == -1
            columns = [
                F.col("node"), F.coalesce("root", "top").alias("root"),
                F.when(lost, F.col("off")).when(cyclic, F.col("depth")).otherwise(F.col("off") + F.col("depth")).alias("depth"),
            ]
            if with_path:
                columns.append(F.when(lost, F.concat(F.array("top"), F.reverse("via"))).when(~cyclic, F.concat("path", F.reverse("via"))).alias("path"))
            known += [through.select(*columns), done]
        else:
            known.append(part.filter(F.col("state") == OPEN).withColumn("state", F.lit(ROOT)).select(*final))
        done = scratch.keep(reduce(DataFrame.unionAll, known))
    names = ["node", "root", "depth", *(["path"] if with_path else [])]
    whole = roots if done is None else roots.unionAll(done)
    if with_path:
        none = F.lit(None).cast(kind).alias("up")
        endless = [] if done is None else [done.filter("depth = -1").join(given.select("node", F.col("top").alias("up")), "node").select(*names, "up")]
        whole = reduce(DataFrame.unionAll, endless, whole.filter("depth >= 0").select(*names, none))
    return whole.select(F.col("node").alias(node), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), *(["path", "up"] if with_path else []))


def descendants(paths: DataFrame, node: str, path: str = "path", scratch: Scratch | None = None) -> DataFrame:
    """One row for each node and each node below it: ``node``, ``descendant_id``, ``distance`` (1 for a child).

    ``paths`` is what ``hierarchy`` gives with ``with_path``. Below a node on a cycle lie all other nodes of
    the cycle and whatever hangs below any of them, at the fewest steps; no node lies below itself.

    The rows come from each node's own path, so none is gathered at the root of a large tree. A cycle is cut
    above its smallest node, which makes it the trunk of a finite tree with paths of its own; nodes of the
    trunk that a path leaves out are reached once around the cycle.
    """
    endless = paths.filter(F.col("up").isNotNull())
    cut = hierarchy(endless.select(node, F.when(F.col(node) != F.col("root_id"), F.col("up")).alias("up")), node, "up", with_path=True, scratch=scratch)
    cut = cut.select(node, "root_id", F.col("path").alias(path))
    last = endless.filter(F.col(node) == F.col("root_id")).select(F.col("up").alias(node))
    trunk = cut.join(last, node).select("root_id", F.col(path).alias("trunk"))

    up = F.slice(F.col(path), F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    finite = paths.filter(F.size(path) > 1).select(node, path).unionAll(cut.filter(F.size(path) > 1).select(node, path))
    rows = finite.select(F.col(node).alias("descendant_id"), F.size(path).alias("__n"), F.posexplode(up).alias("__at", node))
    direct = rows.select(node, "descendant_id", (F.col("__n") - 1 - F.col("__at")).alias("distance"))

    shared, n = F.size(F.array_intersect(path, "trunk")), F.size("trunk")
    beyond = F.slice(F.col("trunk"), shared + 1, n - shared)
    turn = cut.join(trunk, "root_id").select(F.col(node).alias("descendant_id"), F.size(path).alias("__n"), (n - shared).alias("__left"), F.posexplode(beyond).alias("__at", node))
    return direct.unionAll(turn.select(node, "descendant_id", (F.col("__n") - 1 + F.col("__left") - F.col("__at")).alias("distance")))
