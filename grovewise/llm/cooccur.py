"""How often two items occur in the same basket, and how much more often than chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.functions import ids
from grovewise.llm.consolidate import unpacked_hex
from grovewise.storage import Scratch


def _packed(tips: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16 lower-case hex digits as int64 of the same order, and which of ``tips`` (no nulls) are such."""
    fits = pc.match_substring_regex(tips, "^[0-9a-f]{16}$").to_numpy(False)
    digits = np.frombuffer("".join(tips.filter(pa.array(fits)).to_pylist()).encode(), np.uint8).reshape(-1, 16).astype(np.uint64)
    digits = np.where(digits >= 97, digits - 87, digits - 48)
    numbers = np.zeros(len(digits), np.uint64)
    for k in range(16):
        numbers = numbers << np.uint64(4) | digits[:, k]
    whole = np.zeros(len(tips), np.int64)
    whole[fits] = (numbers ^ np.uint64(1 << 63)).view(np.int64)
    return whole, fits


def tip_sets(baskets: DataFrame, scope: str, items: str) -> DataFrame:
    """``scope``, ``items`` (the basket's distinct tips of 16 hex digits as sorted bigints) and ``odd`` (its other tips, sorted).

    Tips are those of ``ids.tip_id``. Each distinct spelling of a batch is mended and packed once. Baskets
    without a tip and rows with a null scope are left out.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pc.list_parent_indices(batch.column(1)).to_numpy()
            spelled = batch.column(1).flatten().dictionary_encode()
            tips = ids.canonical_tips(spelled.dictionary)
            known = tips.is_valid().to_numpy(False)
            packed, fits = _packed(pc.fill_null(tips, ""))
            code = pc.fill_null(spelled.indices, -1).to_numpy()
            arrays = []
            for values, take in ((packed, known & fits), (np.array(tips.to_pylist(), object), known & ~fits)):
                at = np.flatnonzero(np.r_[take, False][code])
                held, of = values[code[at]], row[at]
                order = np.lexsort((held if held.dtype == np.int64 else np.unique(held.astype(str), return_inverse=True)[1], of))
                held, of = held[order], of[order]
                new = np.r_[True, (held[1:] != held[:-1]) | (of[1:] != of[:-1])] if len(of) else np.zeros(0, bool)
                offsets = np.r_[0, np.cumsum(np.bincount(of[new], minlength=batch.num_rows))].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(held[new], pa.int64() if held.dtype == np.int64 else pa.string())))
            whole = pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[scope, "items", "odd"])
            yield whole.filter(pc.greater(pc.add(pc.list_value_length(arrays[0]), pc.list_value_length(arrays[1])), 0))

    kind = baskets.schema[scope].dataType.simpleString()
    return baskets.filter(F.col(scope).isNotNull()).select(scope, items).mapInArrow(sets, f"`{scope}` {kind}, items array<bigint>, odd array<string>")


def votes_within(baskets: DataFrame, scope: str, items: str, members: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``grp``, ``votes``: the counts of the pairs of tips of each group of ``members(grp, tip)``, added up.

    Baskets are told apart by their whole sets; then only tips of a group go on, and pairs are counted
    within each basket's share of a group.
    """
    scratch = scratch or Scratch(baskets.sparkSession)
    named = F.concat(F.transform("items", unpacked_hex), "odd").alias("items")
    sets = scratch.keep(tip_sets(baskets, scope, items).distinct().select(named, F.monotonically_increasing_id().alias("basket")))
    shares = sets.select("basket", F.explode("items").alias("tip")).join(members.select("grp", "tip").distinct(), "tip")
    shares = shares.groupBy("basket", "grp").agg(F.collect_list("tip").alias("items")).filter(F.size("items") > 1)
    return together(shares, "grp", "items", once=False, scratch=scratch).groupBy("grp").agg(F.sum("n_ab").alias("votes"))


def tips_together(baskets: DataFrame, scope: str, items: str, scratch: Scratch | None = None, **thresholds) -> DataFrame:
    """``together`` of the tips in baskets of raw ids. Tips of 16 hex digits are worked on as numbers; where any
    other tip occurs, all are strings."""
    scratch = scratch or Scratch(baskets.sparkSession)
    sets = scratch.keep(tip_sets(baskets, scope, items))
    if sets.filter(F.size("odd") > 0).isEmpty():
        found = together(sets.select(scope, "items"), scope, "items", scratch=scratch, **thresholds)
        return found.withColumns({c: unpacked_hex(F.col(c)) for c in ("item_a", "item_b")})
    named = sets.select(scope, F.concat(F.transform("items", unpacked_hex), "odd").alias("items"))
    return together(named, scope, "items", scratch=scratch, **thresholds)


def together(
    baskets: DataFrame, scope: str, items: str, min_together: int = 1, min_lift: float | None = None,
    chunk: int = 64, once: bool = True, scratch: Scratch | None = None,
) -> DataFrame:
    """Pairs of items of a scope, with the number of distinct baskets that hold each and both.

    ``baskets`` has one row a basket: ``scope`` and ``items``, an array. Baskets of a scope with the same
    set of items count once (each counts where ``once`` is false); null items and repeats within a basket don't count; baskets without items
    and rows with a null scope are left out. Result: scope, ``item_a`` < ``item_b``, ``n_ab``, ``n_a``,
    ``n_b``, ``n_baskets`` of the scope, ``lift`` = n_ab * n_baskets / (n_a * n_b) and ``pmi`` = log2(lift).
    Only pairs with n_ab >= min_together and lift >= min_lift come out (compared in integers where
    ``min_lift`` is one).

    Method: large-basket blocking. A basket of more than ``chunk`` items is split by hash into chunks of
    about that size, and each pair of its chunks is a row of its own, so that the product of a huge basket
    is spread over tasks; smaller baskets are one chunk paired with itself. Pairs are counted by two
    numbers that stand for the items, combined in each partition before the shuffle. Items that cannot
    reach the thresholds with any partner are left out first, which loses no pair: n_ab is at most the
    smaller of n_a and n_b, so n_a >= min_together and n_baskets >= min_lift * n_a must hold.
    """
    scratch = scratch or Scratch(baskets.sparkSession)
    kept = F.sort_array(F.array_distinct(F.array_compact(items)))  # compiled, unlike array_sort and filter
    sets = baskets.filter(F.col(scope).isNotNull()).select(F.col(scope).alias("scope"), kept.alias("items"))
    sets = sets.filter(F.size("items") > 0)
    sets = scratch.keep((sets.distinct() if once else sets).withColumn("basket", F.monotonically_increasing_id()))
    totals = sets.groupBy("scope").agg(F.count(F.lit(1)).alias("n_baskets"))
    rows = sets.select("scope", "basket", F.ceil(F.size("items") / chunk).cast("int").alias("chunks"), F.explode("items").alias("item"))
    stats = rows.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n")).join(totals, "scope")
    stats = stats.filter(F.col("n") >= min_together)
    if min_lift is not None:
        stats = stats.filter(F.col("n_baskets") >= F.lit(min_lift) * F.col("n"))
    stats = scratch.keep(stats.withColumn("number", F.monotonically_increasing_id()))

    numbered = rows.join(stats.select("scope", "item", "number"), ["scope", "item"]).select("basket", "chunks", "number")
    part = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("number"), F.col("chunks")).cast("int")).otherwise(0)
    parts = numbered.groupBy("basket", "chunks", part.alias("part")).agg(F.collect_list("number").alias("held"))
    # each chunk meets every chunk of its basket, itself included, once
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    single = parts.filter(F.col("chunks") == 1).select(F.sort_array("held").alias("a"), F.sort_array("held").alias("b"), F.lit(True).alias("same"))
    spread = parts.filter(F.col("chunks") > 1).select("basket", "part", "held", other)
    spread = spread.select("basket", "part", "held", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    meets = spread.groupBy("basket", "low", "high").agg(
        F.max(F.when(F.col("part") == F.col("low"), F.col("held"))).alias("a"), F.max(F.when(F.col("part") == F.col("high"), F.col("held"))).alias("b"),
    )
    meets = meets.select(F.sort_array("a").alias("a"), F.sort_array("b").alias("b"), (F.col("low") == F.col("high")).alias("same"))
    lefts = single.unionAll(meets.filter(F.col("a").isNotNull() & F.col("b").isNotNull())).select(F.posexplode("a").alias("at", "x"), "b", "same")
    partners = F.when(F.col("same"), F.slice("b", F.col("at") + 2, F.greatest(F.size("b") - F.col("at") - 1, F.lit(0)))).otherwise(F.col("b"))
    pairs = lefts.select("x", F.explode(partners).alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= min_together)

    first = stats.select(F.col("number").alias("x"), "scope", F.col("item").alias("i"), F.col("n").alias("n_i"), "n_baskets")
    second = stats.select(F.col("number").alias("y"), F.col("item").alias("j"), F.col("n").alias("n_j"))
    scored = counted.join(first, "x").join(second, "y")
    if min_lift is not None:
        scored = scored.filter(F.col("n_ab") * F.col("n_baskets") >= F.lit(min_lift) * F.col("n_i") * F.col("n_j"))
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_i") * F.col("n_j"))
    up = F.col("i") < F.col("j")
    return scored.select(
        F.col("scope").alias(scope), F.least("i", "j").alias("item_a"), F.greatest("i", "j").alias("item_b"), "n_ab",
        F.when(up, F.col("n_i")).otherwise(F.col("n_j")).alias("n_a"), F.when(up, F.col("n_j")).otherwise(F.col("n_i")).alias("n_b"),
        "n_baskets", lift.alias("lift"), F.log2(lift).alias("pmi"),
    )
