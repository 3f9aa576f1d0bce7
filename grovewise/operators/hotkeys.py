"""Per-key results where a few keys hold most rows: combine before the shuffle, ship only partial states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals_per_key(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Algebraic aggregates (count, sum, min, max, ...) of each key.

    Spark combines rows in a hash table of each partition and shuffles one partial state a key and
    partition, so a key with a third of all rows costs no more than any other. Null keys form a group
    of their own; an empty table gives an empty result.
    """
    return df.groupBy(*keys).agg(*(a.alias(name) for name, a in aggregates.items()))


def _first_rows(table: pa.Table, keys: list[str], order: list[tuple[str, str]], k: int) -> pa.Table:
    """The first k rows of each key of a small table, sorted."""
    codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in keys]
    rank = pc.sort_indices(
        pa.table([pa.array(_joint(codes)), *(_nan_last(table.column(c)) for c, _ in order)], names=[str(i) for i in range(len(order) + 1)]),
        sort_keys=[("0", "ascending"), *((str(i), way) for i, (_, way) in enumerate(order, 1))],
    ).to_numpy()
    code = _joint(codes)[rank]
    new = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
    at = np.arange(len(code))
    begins = np.maximum.accumulate(np.where(new, at, 0)) if len(code) else at
    return table.take(pa.array(rank[at - begins < k]))


def _nan_last(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """NaN as null: neither is among the best."""
    return pc.if_else(pc.is_nan(column), None, column) if pa.types.is_floating(column.type) else column


def _joint(codes: list[np.ndarray]) -> np.ndarray:
    """One integer for each combination of codes."""
    joint = codes[0].astype(np.int64)
    for code in codes[1:]:
        joint = joint * (int(code.max(initial=0)) + 1) + code
        joint = np.unique(joint, return_inverse=True)[1]
    return joint


def top_per_key(
    df: DataFrame, keys: list[str], order: list[tuple[str, str]], k: int,
    columns: list[str] | None = None, table_rows: int = 200_000,
) -> DataFrame:
    """The first ``k`` rows of each key by ``order`` (pairs of column and "ascending"/"descending").

    Method: each partition keeps a bounded table of key states, a state being the key's k best rows so
    far. States merge by taking the k best of both. When a table still exceeds ``table_rows`` after a
    merge it spills: its states go out and it starts empty. Only states are shuffled, at most k rows a
    key and spill, and a final merge takes the k best of them. All rows take part whatever their key's
    share.

    Ties beyond ``order`` are broken arbitrarily, so name a unique last column. Repeated rows count each.
    Null keys form a group of their own; nulls and NaN in ``order`` come last. Columns are those of
    ``columns`` (default: all); an empty table gives an empty result.
    """
    kept = columns or df.columns
    narrow = df.select(*kept)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
            if rows > table_rows:
                merged = _first_rows(pa.concat_tables(held), keys, order, k)
                held, rows = [merged], merged.num_rows
                if rows > table_rows // 2:
                    yield from merged.combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from _first_rows(pa.concat_tables(held), keys, order, k).combine_chunks().to_batches()

    states = narrow.mapInArrow(combine, narrow.schema)
    known = lambda c: F.nanvl(F.col(c), F.lit(None)) if narrow.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
    by = [known(c).desc_nulls_last() if way == "descending" else known(c).asc_nulls_last() for c, way in order]
    place = "_".join(["__place", *kept])  # longer than any name given
    ranked = states.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.filter(F.col(f"`{place}`") <= k).drop(place)
