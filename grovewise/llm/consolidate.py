"""One group id for all records that pairwise matches link, directly or through others."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.storage import Scratch

_LOW = 0xFFFFFFFF


def _mix(half: Column, key: int) -> Column:
    """A hash of a number below 2^32, itself below 2^32; no product reaches 2^63."""
    return F.shiftrightunsigned(half * F.lit(key & 0x7FFFFFFF | 1) + F.lit(key >> 31 & 0x3FFFFFFF), 13).bitwiseAND(F.lit(_LOW))


def _shuffled(x: Column, keys: list[int]) -> Column:
    """A one-to-one hash of 64-bit numbers (a Feistel network), so that the least hash tells its number."""
    a, b = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    for k in keys:
        a, b = b, a.bitwiseXOR(_mix(b, k))
    return F.shiftleft(a, 32).bitwiseOR(b)


def _unshuffled(x: Column, keys: list[int]) -> Column:
    a, b = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    for k in reversed(keys):
        a, b = b.bitwiseXOR(_mix(a, k)), a
    return F.shiftleft(a, 32).bitwiseOR(b)


def contract(edges: DataFrame, seed: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """The vertices of ``edges`` (bigint ``a``, ``b``), each with one ``rep`` for its whole component.

    Method: random contraction. In each round every vertex hooks to the one of its neighbours and itself
    that comes first by a fresh hash order; edges are relabelled, loops and repeats dropped; this is
    repeated until no edge is left (the vertices shrink by a constant share each round, in expectation,
    whatever the shape of the graph). Then the mappings are expanded, last round first. The first of the
    neighbours is a minimum, combined in each partition before the shuffle, so a vertex that a third of
    the edges touch is no hot key there; the relabelling joins have one row a vertex on one side, and
    Spark splits a hot key's rows on the other. Each round is a table in the shared folder.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    rng = random.Random(seed)
    rest = scratch.keep(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not rest.isEmpty():
        keys = [rng.getrandbits(61) for _ in range(4)]
        ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")
        first = rest.select(ends).select("e.v", "e.u").groupBy("v").agg(F.min(_shuffled(F.col("u"), keys)).alias("first"))
        hooks = scratch.keep(first.select("v", _unshuffled(F.least("first", _shuffled(F.col("v"), keys)), keys).alias("rep")))
        maps.append(hooks)
        half = rest.join(hooks.select(F.col("v").alias("a"), F.col("rep").alias("x")), "a").select("x", "b")
        moved = half.join(hooks.select(F.col("v").alias("b"), F.col("rep").alias("y")), "b").filter(F.col("x") != F.col("y"))
        smaller = scratch.keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(rest)
        rest = smaller
    if not maps:
        return rest.select(F.col("a").alias("v"), F.col("b").alias("rep"))
    whole = maps[-1]
    for hooks in reversed(maps[:-1]):
        further = whole.select(F.col("v").alias("rep"), F.col("rep").alias("last"))
        whole = hooks.join(further, "rep", "left").select("v", F.coalesce("last", "rep").alias("rep"))
    return whole


def consolidate(vertices: DataFrame, edges: DataFrame, seed: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """Every vertex (bigint ``v``) with ``least``, the smallest vertex of its component.

    ``edges`` has bigint ``a`` and ``b``; loops, repeats, either direction and rows with a null end are
    fine. A vertex without edges is its own component; a vertex of an edge that ``vertices`` lacks has no
    row. Empty tables give an empty result.
    """
    scratch = scratch or Scratch(vertices.sparkSession)
    linked = scratch.keep(contract(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()), seed, scratch))
    least = linked.groupBy("rep").agg(F.min("v").alias("least"))
    named = linked.join(least, "rep").select("v", "least")
    return vertices.select("v").distinct().join(named, "v", "left").select("v", F.coalesce("least", "v").alias("least"))


def packed_hex(c: Column) -> Column:
    """16 lower-case hex digits as a bigint of the same order; null for any other string."""
    high, low = (F.conv(F.substring(c, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    number = F.shiftleft(high.bitwiseXOR(F.lit(0x80000000)), 32).bitwiseOR(low)
    return F.when(c.rlike("^[0-9a-f]{16}$"), number)


def unpacked_hex(c: Column) -> Column:
    high = F.shiftrightunsigned(c, 32).bitwiseXOR(F.lit(0x80000000))
    halves = (F.lpad(F.lower(F.hex(x)), 8, "0") for x in (high, c.bitwiseAND(F.lit(_LOW))))
    return F.concat(*halves)


def sets_of(pairs: DataFrame, a: str, b: str, linked: Column, scratch: Scratch | None = None) -> DataFrame:
    """``id`` and ``set_id`` (the smallest id of the set) of every id in ``a`` or ``b``.

    Rows link their two ids where ``linked`` is true; null ids are none. Ids of 16 hex digits are worked on
    as numbers; where any other id occurs, ids are numbered in a table first.
    """
    scratch = scratch or Scratch(pairs.sparkSession)
    both = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & F.coalesce(linked, F.lit(False))
    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), both.alias("linked"))
    packed = scratch.keep(rows.select(packed_hex(F.col("a")).alias("a"), packed_hex(F.col("b")).alias("b"), "linked", F.when(packed_hex(F.col("a")).isNull(), F.col("a")).alias("odd_a"), F.when(packed_hex(F.col("b")).isNull(), F.col("b")).alias("odd_b")))
    if packed.filter(F.col("odd_a").isNotNull() | F.col("odd_b").isNotNull()).isEmpty():
        ends = packed.select(F.explode(F.array("a", "b")).alias("v")).filter(F.col("v").isNotNull())
        found = consolidate(ends, packed.filter("linked").select("a", "b"), scratch=scratch)
        return found.select(unpacked_hex(F.col("v")).alias("id"), unpacked_hex(F.col("least")).alias("set_id"))
    ids = rows.select(F.explode(F.array("a", "b")).alias("id")).filter(F.col("id").isNotNull()).distinct()
    ids = scratch.keep(ids.withColumn("v", F.monotonically_increasing_id()))
    named = lambda c, to: ids.select(F.col("id").alias(c), F.col("v").alias(to))
    edges = rows.filter("linked").join(named("a", "x"), "a").join(named("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = scratch.keep(contract(edges, scratch=scratch).join(ids, "v"))
    least = joined.groupBy("rep").agg(F.min("id").alias("set_id"))
    return ids.select("id").join(joined.join(least, "rep").select("id", "set_id"), "id", "left").select("id", F.coalesce("set_id", "id").alias("set_id"))
