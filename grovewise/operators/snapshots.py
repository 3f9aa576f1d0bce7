"""Current rows of deliveries, and what changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_rows(df: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """The row of each key with the greatest ``at``.

    Rows are combined within a partition before the shuffle. A null ``at`` is older than any other;
    rows that tie there must agree, else the greatest by ``values`` is taken. Columns: keys and values.
    """
    best = F.max(F.struct(F.col(at), *values)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col("__row")[v].alias(v) for v in values))


def changes(df: DataFrame, index: str, last: int | Column, key: str, values: list[str], first: int | Column = 0) -> DataFrame:
    """Added, removed and changed keys between consecutive snapshots.

    ``df`` has one row for each key and snapshot that holds it; ``index`` numbers the snapshots
    consecutively from ``first`` to ``last``. Each key's rows are windowed by that index. The hash of the
    values one row before reveals a change (an exact comparison decides where hashes are equal); a gap in
    the index reveals a removal and a later addition. Every window holds at most as many rows as there
    are snapshots, so no key is a hot one.

    Result: key, index (of the later snapshot), change. A null value differs from any other value and
    equals null. Rows with a null key or index are left out: they are in no snapshot.
    """
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    w = Window.partitionBy(key).orderBy(index)
    rows = df.filter(F.col(key).isNotNull() & F.col(index).isNotNull()).select(key, index, *values)
    seen = rows.select(
        F.col(key), F.col(index).alias("__at"),
        F.lag(index).over(w).alias("__before"), F.lead(index).over(w).alias("__after"),
        F.xxhash64(*values).alias("__hash"), F.lag(F.xxhash64(*values)).over(w).alias("__old_hash"),
        F.struct(*values).alias("__now"), F.lag(F.struct(*values)).over(w).alias("__old"),
    )
    follows = F.col("__before") == F.col("__at") - 1
    differs = (F.col("__hash") != F.col("__old_hash")) | ~F.col("__now").eqNullSafe(F.col("__old"))
    came = F.when(
        F.col("__at") > first,
        F.when(~F.coalesce(follows, F.lit(False)), F.lit("added")).when(differs, F.lit("changed")),
    )
    gone = (F.col("__at") < last) & (F.col("__after").isNull() | (F.col("__after") > F.col("__at") + 1))
    events = F.array(
        F.when(came.isNotNull(), F.struct(F.col("__at").alias("at"), came.alias("change"))),
        F.when(gone, F.struct((F.col("__at") + 1).alias("at"), F.lit("removed").alias("change"))),
    )
    found = seen.select(key, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("__event"))
    return found.select(key, F.col("__event.at").alias(index), F.col("__event.change").alias("change"))
