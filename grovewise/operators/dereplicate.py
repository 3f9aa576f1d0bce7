"""One row for each distinct content, with all that carried it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.functions import records


def dereplicate(rows: DataFrame, seq: str, order: str) -> DataFrame:
    """``input_id``, the sequence first seen, and the number of records of each content (A1).

    Orientation doesn't matter for the id. Null and empty sequences are left out. Ties in ``order`` go to
    the smaller sequence. States are combined in each partition, so a content with a third of all rows is
    no hot key; the names that carried a content are a table of their own (``carriers``), never one list.
    """
    clean = rows.select(records.cleaned(F.col(seq)).alias("seq"), F.col(order).alias("ord"))
    clean = clean.filter(F.col("seq") != "").withColumn("input_id", records.content_id(F.col("seq")))
    first = F.min(F.struct("ord", "seq"))
    return clean.groupBy("input_id").agg(first["seq"].alias("seq"), F.count(F.lit(1)).alias("n_records"))


def carriers(rows: DataFrame, seq: str, name: str) -> DataFrame:
    """``input_id`` and each distinct name that carried it."""
    clean = rows.select(records.cleaned(F.col(seq)).alias("seq"), F.col(name).alias("name")).filter(F.col("seq") != "")
    return clean.select(records.content_id(F.col("seq")).alias("input_id"), "name").distinct()


def summary(rows: DataFrame, seq: str) -> DataFrame:
    """Records, empty ones, distinct contents, contents seen once, largest number of copies."""
    clean = rows.select(records.cleaned(F.coalesce(F.col(seq), F.lit(""))).alias("seq"))
    copies = clean.groupBy(F.when(F.col("seq") != "", records.content_id(F.col("seq"))).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    full = F.col("id").isNotNull()
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("empty"),
        F.count("id").alias("sequences"), F.count_if(full & (F.col("n") == 1)).alias("singletons"),
        F.coalesce(F.max(F.when(full, F.col("n"))), F.lit(0)).alias("largest"),
    )
