"""Items of varying length put whole into containers of one capacity."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovewise.storage import Scratch


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Shortest-pack-first over a histogram of lengths (1 to ``capacity``).

    Lengths are placed longest first, each into the packs with the most space left; where it doesn't fit
    there, new packs are opened. Packs with the same content are one pattern with a count, so the work
    depends on the number of lengths, not of items.

    Returns the placing as rows (length, rank_from, rank_to, pack, times), sorted: items of that length
    with ranks rank_from up to rank_to (excluded) go into packs from ``pack`` on, ``times`` into each;
    and the number of packs. A pattern holds at most sqrt(2 * capacity) distinct lengths, and each
    length adds at most three patterns, so there are at most 3 * capacity * sqrt(2 * capacity) rows.
    """
    heap: list[tuple[int, int, int, tuple | None]] = []  # (-space left, tie-break, packs, content)
    serial = 0

    def push(space: int, packs: int, content: tuple | None) -> None:
        nonlocal serial
        if packs:
            heapq.heappush(heap, (-space, serial, packs, content))
            serial += 1

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if heap and -heap[0][0] >= length:
                space, _, packs, content = heapq.heappop(heap)
                used = min(packs, left)
                push(-space, packs - used, content)
                times = content[1] + 1 if content[0] == length else 1
                before = content[2] if content[0] == length else content
                push(-space - length, used, (length, times, before))
                left -= used
            else:
                each = capacity // length
                push(capacity - each * length, left // each, (length, each, None))
                if left % each:
                    push(capacity - left % each * length, 1, (length, left % each, None))
                left = 0
    rows, ranks, pack = [], dict.fromkeys(counts, 0), 0
    for _, _, packs, content in sorted(heap):
        while content:
            length, times, content = content
            rows.append((length, ranks[length], ranks[length] + times * packs, pack, times))
            ranks[length] += times * packs
        pack += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5), pack


def packed(
    sizes: DataFrame, key: str, size: str, capacity: int, hot_rows: int = 200_000, scratch: Scratch | None = None
) -> DataFrame:
    """``key``, ``part``, ``length`` and ``container_id`` of every item.

    ``sizes`` has one row an item with a unique ``key``; an item larger than ``capacity`` is split into
    parts of ``capacity`` and a rest, any other stays whole (part 0). An item of size 0 or null takes no
    space and lies in container 0. Repeated keys are items of their own.

    Method: shortest-pack-first over the histogram of lengths, which has at most ``capacity`` entries and
    is all that reaches the driver besides row counts; the placing found there (its size is bounded by
    ``capacity``) is joined back by each item's rank among those of its length, in the order of a hash of
    the key. Lengths with more than ``hot_rows`` items are ranked in several ranges of that hash, whose
    counts shift the ranks, so a length with a third of all items is not one task; the ranks depend neither
    on the ranges nor on partitioning.
    """
    scratch = scratch or Scratch(sizes.sparkSession)
    whole = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    parts = F.greatest(F.ceil(whole / capacity).cast("int"), F.lit(1))
    items = sizes.select(F.col(key).alias("key"), whole.alias("whole"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    items = scratch.keep(items.select("key", "part", F.least(F.col("whole") - F.col("part").cast("long") * capacity, F.lit(capacity)).cast("int").alias("length")))
    counts = {r[0]: r[1] for r in items.filter(F.col("length") > 0).groupBy("length").count().collect()}
    placing, _ = pack_histogram(counts, capacity)

    split = {length: -(-n // hot_rows) for length, n in counts.items() if n > hot_rows}
    at = F.shiftrightunsigned(F.xxhash64("key", "part"), 32)
    part = F.lit(0)
    if split:  # at most as many entries as there are lengths
        ways = F.create_map(*(F.lit(x) for pair in split.items() for x in pair))
        part = F.shiftright(at * F.coalesce(F.element_at(ways, F.col("length")), F.lit(1)), 32).cast("int")
    placed = items.filter(F.col("length") > 0).withColumn("__at", at).withColumn("__hash_part", part)
    shift: dict[tuple[int, int], int] = {}
    if split:  # (items of hot lengths / hot_rows) rows
        seen = placed.filter(F.col("length").isin(list(split))).groupBy("length", "__hash_part").count().orderBy("length", "__hash_part").collect()
        before: dict[int, int] = {}
        for length, h, n in seen:
            shift[length, h] = before.get(length, 0)
            before[length] = shift[length, h] + n
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "__hash_part").orderBy("__at", "key", "part")))
    sent = sizes.sparkSession.sparkContext.broadcast((placing, shift))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shifts = sent.value
        table = rows[:, 0] << 40 | rows[:, 1]
        for batch in batches:
            length, h, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
            rank = rank - 1
            if shifts:
                joint, which = np.unique(length << 32 | h, return_inverse=True)
                rank = rank + np.array([shifts.get((int(x) >> 32, int(x) & 0xFFFFFFFF), 0) for x in joint], np.int64)[which]
            row = rows[np.searchsorted(table, length << 40 | rank, "right") - 1]
            container = row[:, 3] + (rank - row[:, 1]) // row[:, 4] if len(rank) else rank
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(container)], names=[key, "part", "length", "container_id"])

    kind = sizes.schema[key].dataType.simpleString()
    found = ranked.select("key", "part", "length", "__hash_part", "rank").mapInArrow(place, f"`{key}` {kind}, part int, length int, container_id bigint")
    return found.unionAll(items.filter(F.col("length") == 0).select(F.col("key").alias(key), "part", "length", F.lit(0).cast("long").alias("container_id")))
