"""From votes of shards on pairs to the evidence of groups at every level.

Tables: ``votes(component, shard, i, j, v)`` with i < j and v FLOAT; ``group_of(component, level, tip, grp)``.
i, j are tips or units; all functions work alike on both. Counts are integers until one division at the end,
so results don't depend on partitioning. A pair that no shard saw has no row and is no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pair_votes(rows: DataFrame, shard: str, tip: str, value: str) -> DataFrame:
    """Votes of each shard on each pair of its tips: the distance of their values, as FLOAT.

    Shards are bounded by design (150 to 180 tips), so the pairs of a shard are too.
    """
    a = rows.select(F.col(shard).alias("shard"), F.col(tip).alias("i"), F.col(value).alias("x"))
    b = rows.select(F.col(shard).alias("shard"), F.col(tip).alias("j"), F.col(value).alias("y"))
    return a.join(b, "shard").filter(F.col("i") < F.col("j")).select("shard", "i", "j", F.abs(F.col("x") - F.col("y")).cast("float").alias("v"))


def consensus(votes: DataFrame, levels: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Median, number of votes, and hits at each level of each pair.

    The median is (v[(n-1)/2] + v[n/2]) / 2 in FLOAT arithmetic; a hit is a vote <= level, compared in
    FLOAT. The votes of a pair, at most one a shard, meet in one task, sorted, which spills to disk; runs of sorted rows
    go through Arrow, where only the last pair of a run waits for the next (4 bytes a vote). Missing votes (null) count in ``votes`` only.
    Result: keys, i, j, med, votes, hits (array, by level).
    """
    of = [*keys, "i", "j"]
    at = [np.float32(x) for x in levels]
    types = [votes.schema[c].dataType.simpleString() for c in of]
    known = F.col("v") if votes.schema["v"].dataType == T.FloatType() else F.col("v").cast("double").alias("v")
    met = votes.select(*of, known).repartition(*of).sortWithinPartitions(*of, "v")

    def told(first: pa.Table, v: np.ndarray, seen: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs by their first rows; ``starts`` are where the votes of each begin, those that are missing first."""
        total = np.diff(starts, append=len(v))
        n = np.add.reduceat(seen, starts, dtype=np.int64)
        begin = starts + total - n
        low, high = (v[np.minimum(begin + k, len(v) - 1)].astype(np.float32) for k in ((n - 1).clip(0) // 2, n // 2))
        med = ((low + high).astype(np.float64) / 2).astype(np.float32)
        hits = np.stack([np.add.reduceat(seen & (v <= x), starts, dtype=np.int64) for x in at], 1).ravel() if at else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * len(at)), pa.array(hits))
        columns = [*first.combine_chunks().columns, pa.array(med, mask=n == 0), pa.array(total, pa.int64()), lists]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield pa.RecordBatch.from_arrays(columns, names=[*of, "med", "votes", "hits"])

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: pa.RecordBatch | None = None  # of the last pair, with its votes so far
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            names, own = batch.select(of), batch.column("v")
            v, seen = own.to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False)
            new = np.zeros(len(batch), bool)
            for c in names.columns:
                new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
                if c.null_count:
                    none = c.is_null().to_numpy(zero_copy_only=False)
                    new[1:] |= none[1:] != none[:-1]
            new[0] = key is None or names.slice(0, 1).to_pylist() != key.to_pylist()
            starts = np.flatnonzero(new)
            if len(starts):
                last = starts[-1]
                before = sum(len(x) for x, _ in held)
                found = [0] * (key is not None) + (starts[:-1] + before).tolist()
                if found:
                    first = [names.take(pa.array(starts[:-1]))] if key is None else [key, names.take(pa.array(starts[:-1]))]
                    x, y = (np.concatenate([*(h[k] for h in held), z[:last]]) for k, z in enumerate((v, seen)))
                    yield from told(pa.Table.from_batches(first), x, y, np.array(found))
                key, held = names.slice(int(last), 1), [(v[last:].copy(), seen[last:].copy())]
            else:
                held.append((v.copy(), seen.copy()))
        if key is not None:
            x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            yield from told(pa.Table.from_batches([key]), x, y, np.array([0]))

    schema = ", ".join(f"`{c}` {t}" for c, t in zip(of, types))
    return met.mapInArrow(medians, f"{schema}, med float, votes bigint, hits array<bigint>")


#: Votes that a task holds before it sends them on, and blocks of pairs a task of the medians.
HELD, PIECES = 1_000_000, 16
MISSING = np.uint32(0xFFFFFFFF)


def _dealt(tip: np.ndarray, x: np.ndarray, none: np.ndarray, shard: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The votes of whole shards, at most about ``HELD`` at once: i, j (i < j), the bits of the vote. Bits of numbers from 0 on rise with them."""
    order = np.lexsort((x, none, tip, shard))
    tip, x, none, shard = tip[order], x[order], none[order], shard[order]
    first = np.ones(len(tip), bool)
    first[1:] = (shard[1:] != shard[:-1]) | (tip[1:] != tip[:-1])
    tip, x, none, shard = tip[first], x[first], none[first], shard[first]
    at = np.arange(len(tip))
    more = np.searchsorted(shard, shard, "right") - at - 1
    before = more.cumsum() - more
    lo = 0
    while lo < len(tip):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + HELD)))
        a = np.repeat(at[lo:hi], more[lo:hi])
        b = np.arange(len(a)) + np.repeat(at[lo:hi] + 1 - (before[lo:hi] - before[lo]), more[lo:hi])
        with np.errstate(all="ignore"):
            v = np.abs(x[a] - x[b]).astype(np.float32).view(np.uint32)
        v[none[a] | none[b]] = MISSING
        yield tip[a], tip[b], v
        lo = hi


def _medians(i: np.ndarray, j: np.ndarray, v: np.ndarray, levels: list[np.float32]) -> tuple[np.ndarray, ...]:
    """i, j, median, votes, those not missing, and hits by level of each pair."""
    low, width = (int(i.min()), int(j.min())), int(j.max()) - int(j.min()) + 1
    if (int(i.max()) - low[0] + 1) * width < 2**32:  # a pair and its vote in one number
        row = np.sort(((i - low[0]).astype(np.uint64) * np.uint64(width) + (j - low[1]).astype(np.uint64)) << np.uint64(32) | v)
        pair, v = row >> np.uint64(32), row.astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        i, j = ((z.astype(np.int64) + x) for z, x in zip(np.divmod(pair[starts], np.uint64(width)), low))
    else:
        order = np.lexsort((v, j, i))
        i, j, v = i[order], j[order], v[order]
        starts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        i, j = i[starts], j[starts]
    total = np.diff(starts, append=len(v))
    n = total - np.add.reduceat(v == MISSING, starts, dtype=np.int64)
    x, y = (v[starts + k].view(np.float32) for k in ((n - 1).clip(0) // 2, np.minimum(n // 2, total - 1)))
    with np.errstate(all="ignore"):
        hits = [np.add.reduceat(v.view(np.float32) <= x, starts, dtype=np.int64) for x in levels]  # a missing vote is not a number
        return i, j, ((x + y).astype(np.float64) / 2).astype(np.float32), total, n, np.stack(hits, 1).ravel() if hits else np.zeros(0, np.int64)


def shard_medians(rows: DataFrame, shard: str, tip: str, value: str, levels: list[float] | None = None) -> DataFrame:
    """Median and number of the votes on each pair of tips, as ``consensus(pair_votes(rows), levels)``: i, j, med, votes, and with ``levels`` hits.

    A tip that a shard has more than once counts with its least value. No vote is a row: the tasks of the shards send the
    votes in blocks, by a hash of their pair, to ``PIECES`` blocks a task, where each block is sorted at once (about 40 bytes
    a vote). Other than whole tips, floating values and whole or text shards take the rows of ``consensus``.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(shard).alias("shard"), F.col(tip).alias("tip"), F.col(value).alias("x")).filter(F.col("shard").isNotNull() & F.col("tip").isNotNull())
    shard_kind, kind, value_kind = (own.schema[c].dataType.simpleString() for c in ("shard", "tip", "x"))
    whole = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    if kind not in whole or shard_kind not in {*whole, "string"} or value_kind not in ("float", "double"):
        least = own.repartition("shard").groupBy("shard", "tip").agg(F.min("x").alias("x"))
        found = consensus(pair_votes(least, "shard", "tip", "x"), levels or [])
        return found if levels is not None else found.drop("hits")
    at = [np.float32(x) for x in levels or []]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = tasks * PIECES

    def sent(votes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        i, j, v = (np.concatenate(x) for x in zip(*votes))
        mixed = (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (j.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        block = ((mixed >> np.uint64(32)) % np.uint64(blocks)).astype(np.uint16 if blocks < 2**16 else np.uint32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = [*starts[1:].tolist(), len(block)]
        least, most = min(i.min(), j.min()), max(i.max(), j.max())
        kind = np.int32 if -(2**31) <= least and most < 2**31 else np.int64
        columns = [x[order] for x in (i.astype(kind), j.astype(kind), v)]
        packed = [pa.array([memoryview(x[lo:hi]).cast("B") for lo, hi in zip(starts.tolist(), ends)], pa.binary()) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array(block[starts].astype(np.int32)), *packed], names=["block", "i", "j", "v"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out, n = None, [], [], 0  # the rows of the last shard wait for the next batch

        def ready(*parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal out, n
            for votes in _dealt(*parts):
                out.append(votes)
                n += len(votes[0])
                if n >= HELD:
                    yield sent(out)
                    out, n = [], 0

        for batch in batches:
            if not len(batch):
                continue
            names = batch.column("shard")
            new = np.ones(len(batch), bool)
            new[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            new[0] = names[0].as_py() != last
            tip, none = batch.column("tip").to_numpy().astype(np.int64), batch.column("x").is_null().to_numpy(zero_copy_only=False)
            x = pc.fill_null(batch.column("x"), 0.0).to_numpy()
            held.append((tip, x, none, new))
            last = names[-1].as_py()
            if new.any():
                tip, x, none, new = (np.concatenate(z) for z in zip(*held))
                cut = np.flatnonzero(new)[-1]
                if cut:
                    yield from ready(tip[:cut], x[:cut], none[:cut], new[:cut].cumsum())
                held = [(tip[cut:], x[cut:], none[cut:], new[cut:])]
        if held:
            tip, x, none, new = (np.concatenate(z) for z in zip(*held))
            yield from ready(tip, x, none, new.cumsum())
        if n:
            yield sent(out)

    schema = pa.schema([("i", whole[kind]), ("j", whole[kind]), ("med", pa.float32()), ("votes", pa.int64())] + [("hits", pa.list_(pa.int64()))] * (levels is not None))

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                i, j, v = (np.concatenate(x) for x in zip(*held))
                i, j, med, votes, n, hits = _medians(i, j, v, at)
                columns = [pa.array(i).cast(whole[kind]), pa.array(j).cast(whole[kind]), pa.array(med, mask=n == 0), pa.array(votes, pa.int64())]
                if levels is not None:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * len(at)), pa.array(hits)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for name, i, j, v in zip(batch.column("block").to_pylist(), *(batch.column(c) for c in "ijv")):
                if name != block:
                    yield from told()
                    block, held = name, []
                votes = np.frombuffer(v.as_buffer(), np.uint32)
                width = np.int32 if len(i.as_buffer()) == 4 * len(votes) else np.int64
                held.append((*(np.frombuffer(x.as_buffer(), width).astype(np.int64) for x in (i, j)), votes))
        yield from told()

    met = own.repartition("shard").sortWithinPartitions("shard").mapInArrow(dealt, "block int, i binary, j binary, v binary")
    met = met.repartition(tasks, "block").sortWithinPartitions("block")
    return met.mapInArrow(medians, f"i {kind}, j {kind}, med float, votes bigint" + ", hits array<bigint>" * (levels is not None))


def at_levels(pairs: DataFrame, levels: list[float]) -> DataFrame:
    """One row for each pair and level: i, j, level, hits, votes."""
    named = F.arrays_zip(F.array(*(F.lit(float(x)) for x in levels)).alias("level"), F.col("hits").alias("hit"))
    rows = pairs.select(*(c for c in pairs.columns if c not in ("hits", "med")), F.explode(named).alias("z"))
    return rows.select(*(c for c in rows.columns if c != "z"), F.col("z")["level"].alias("level"), F.col("z")["hit"].alias("hits"))


def with_groups(leveled: DataFrame, group_of: DataFrame) -> DataFrame:
    """Pairs with the group of either tip at the level, null for none."""
    left = group_of.select("level", F.col("tip").alias("i"), F.col("grp").alias("gi"))
    right = group_of.select("level", F.col("tip").alias("j"), F.col("grp").alias("gj"))
    return leveled.join(left, ["level", "i"], "left").join(right, ["level", "j"], "left")


def leveled_with_groups(pairs: DataFrame, levels: list[float], group_of: DataFrame) -> DataFrame:
    """``with_groups(at_levels(pairs, levels), group_of)``, where the groups of a tip at all levels come to its pairs at once."""
    kind = group_of.schema["grp"].dataType.simpleString()
    wide = group_of.groupBy("tip").agg(F.array(*(F.max(F.when(F.col("level") == float(x), F.col("grp"))) for x in levels)).alias("g"))
    both = pairs.select(*(c for c in pairs.columns if c != "med"))
    for c in "ij":
        both = both.join(wide.select(F.col("tip").alias(c), F.col("g").alias(f"g{c}")), c, "left")
    none = F.array(*(F.lit(None).cast(kind) for _ in levels))
    zipped = F.arrays_zip(F.array(*(F.lit(float(x)) for x in levels)).alias("level"), F.col("hits").alias("hits"), F.coalesce("gi", none).alias("gi"), F.coalesce("gj", none).alias("gj"))
    rest = [c for c in both.columns if c not in ("hits", "gi", "gj")]
    return both.select(*rest, F.explode(zipped).alias("z")).select(*rest, "z.*")


def _both_ends(grouped: DataFrame) -> DataFrame:
    ends = F.explode(F.array(
        F.struct(F.col("i").alias("tip"), F.col("gi").alias("grp"), F.col("j").alias("other"), F.col("gj").alias("other_grp")),
        F.struct(F.col("j").alias("tip"), F.col("gj").alias("grp"), F.col("i").alias("other"), F.col("gi").alias("other_grp")),
    ))
    return grouped.select("level", "hits", "votes", ends.alias("e")).select("level", "hits", "votes", "e.*")


def membership(grouped: DataFrame) -> DataFrame:
    """Share of hits, votes and partners of each tip over the pairs inside its group (A10)."""
    inside = _both_ends(grouped.filter(F.col("gi") == F.col("gj")))
    sums = inside.groupBy("level", "tip", "grp").agg(F.sum("hits").alias("h"), F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("partners"))
    return sums.select("level", "tip", "grp", (F.col("h") / F.col("votes")).alias("membership"), "votes", "partners")


def cohesion(grouped: DataFrame, group_of: DataFrame) -> DataFrame:
    """Share of hits over the pairs inside each group, votes, pairs, and the share of its pairs seen at all."""
    sums = grouped.filter(F.col("gi") == F.col("gj")).groupBy("level", F.col("gi").alias("grp")).agg(F.sum("hits").alias("h"), F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("pairs"))
    sizes = group_of.filter(F.col("grp").isNotNull()).groupBy("level", "grp").agg(F.count(F.lit(1)).alias("n_tips"))
    whole = sizes.filter(F.col("n_tips") >= 2).join(sums, ["level", "grp"], "left")
    return whole.select(
        "level", "grp", "n_tips", (F.col("h") / F.col("votes")).alias("cohesion"), F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("pairs", F.lit(0)).alias("pairs"),
        (F.coalesce("pairs", F.lit(0)) / (F.col("n_tips") * (F.col("n_tips") - 1) / 2)).alias("held"),
    )


def tip_pull(grouped: DataFrame) -> DataFrame:
    """The outside group, or ungrouped tip, that pulls each tip most.

    Votes across the group's border are pooled by target; the greatest share of hits wins, then more
    votes, groups before tips, the smaller id in its own type. ``target_kind`` is ``group``, ``tip``, or ``nothing_joins``
    (then hits are 0 and votes and partners are totals). Tips without outside votes have no row.
    """
    outside = _both_ends(grouped.filter(F.col("gi").isNull() | F.col("gj").isNull() | (F.col("gi") != F.col("gj"))))
    to_tip = F.when(F.col("other_grp").isNull(), F.col("other"))
    pooled = outside.groupBy("level", "tip", "grp", F.when(F.col("other_grp").isNotNull(), 0).otherwise(1).alias("kind"), F.col("other_grp").alias("to_grp"), to_tip.alias("to_tip")).agg(
        F.sum("hits").alias("h"), F.sum("votes").alias("v"), F.count(F.lit(1)).alias("n")
    )
    best = F.min(F.struct((-F.col("h") / F.col("v")).alias("share"), (-F.col("v")).alias("v"), "kind", "to_grp", "to_tip", "h", "n"))
    each = pooled.groupBy("level", "tip", "grp").agg(best.alias("b"), F.sum("v").alias("all_v"), F.sum("n").alias("all_n"))
    joins = F.col("b.h") > 0
    return each.select(
        "level", "tip", "grp", F.when(joins, -F.col("b.share")).otherwise(F.lit(0.0)).alias("pull"),
        F.when(~joins, "nothing_joins").when(F.col("b.kind") == 0, "group").otherwise("tip").alias("target_kind"), F.when(joins, F.coalesce(F.col("b.to_grp").cast("string"), F.col("b.to_tip").cast("string"))).alias("target"),
        F.when(joins, F.col("b.h")).otherwise(F.lit(0)).cast("bigint").alias("hits"), F.when(joins, -F.col("b.v")).otherwise(F.col("all_v")).alias("votes"),
        F.when(joins, F.col("b.n")).otherwise(F.col("all_n")).alias("partners"),
    )


def group_pull(pulls: DataFrame) -> DataFrame:
    """Pull of each group: its members' hits over their votes, each with its strongest target."""
    sums = pulls.filter(F.col("grp").isNotNull()).groupBy("level", "grp").agg(F.sum("hits").alias("h"), F.sum("votes").alias("v"))
    return sums.select("level", "grp", F.coalesce(F.try_divide("h", "v"), F.lit(0.0)).alias("pull"))


def separation(pairs: DataFrame, group_of: DataFrame) -> DataFrame:
    """Spread of each group and its nearest relatives by observed distances.

    ``pairs(i, j, d)``; result: grp, ``spread`` and ``spread_median`` (greatest and median distance inside),
    ``pairs`` behind them, the ``nearest`` and ``second`` other group, each by its closest tip (with that tip
    and distance; ties go to the smaller tip), the nearest ungrouped tip (``stray``), and the number of
    ungrouped tips closer than the nearest group.
    """
    g = group_of.select("tip", "grp")
    both = pairs.join(g.select(F.col("tip").alias("i"), F.col("grp").alias("gi")), "i", "left").join(g.select(F.col("tip").alias("j"), F.col("grp").alias("gj")), "j", "left")
    inside = both.filter(F.col("gi") == F.col("gj")).groupBy(F.col("gi").alias("grp"))
    inside = inside.agg(F.max("d").alias("spread"), F.percentile(F.col("d").cast("double"), F.lit(0.5)).alias("spread_median"), F.count(F.lit(1)).alias("pairs"))
    ends = F.explode(F.array(F.struct(F.col("gi").alias("grp"), F.col("gj").alias("og"), F.col("j").alias("ot")), F.struct(F.col("gj").alias("grp"), F.col("gi").alias("og"), F.col("i").alias("ot"))))
    out = both.filter(~F.col("gi").eqNullSafe(F.col("gj"))).select("d", ends.alias("e")).select("d", "e.*").filter(F.col("grp").isNotNull())
    closest = out.filter(F.col("og").isNotNull()).groupBy("grp", "og").agg(F.min(F.struct("d", "ot")).alias("c")).select("grp", "c.d", "c.ot", "og")
    first = closest.groupBy("grp").agg(F.min(F.struct("d", "ot", "og")).alias("a"))
    second = closest.join(first, "grp").filter(F.col("og") != F.col("a.og")).groupBy("grp").agg(F.min(F.struct("d", "ot", "og")).alias("b"))
    loose = out.filter(F.col("og").isNull()).groupBy("grp", "ot").agg(F.min("d").alias("d")).join(first, "grp", "left")
    closer = F.count_if(F.col("a").isNull() | (F.col("d") < F.col("a.d")))
    strays = loose.groupBy("grp").agg(F.min(F.struct("d", "ot")).alias("s"), closer.alias("strays_closer"))
    names = g.filter(F.col("grp").isNotNull()).select("grp").distinct()
    whole = names.join(inside, "grp", "left").join(first, "grp", "left").join(second, "grp", "left").join(strays, "grp", "left")
    return whole.select(
        "grp", "spread", "spread_median", F.coalesce("pairs", F.lit(0)).alias("pairs"),
        F.col("a.og").alias("nearest"), F.col("a.ot").alias("nearest_tip"), F.col("a.d").alias("nearest_distance"),
        F.col("b.og").alias("second"), F.col("b.ot").alias("second_tip"), F.col("b.d").alias("second_distance"),
        F.col("s.ot").alias("stray"), F.col("s.d").alias("stray_distance"), F.coalesce("strays_closer", F.lit(0)).alias("strays_closer"),
    )
