"""Arriving records: each content once, assigned to a standing hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.functions import records


def first_arrivals(stream: DataFrame, seq: str, at: str, delay: str) -> DataFrame:
    """Records of a stream by content id, each content once within ``delay`` of event time ``at``.

    State holds one entry a content and is dropped once the watermark has passed it. Null and empty
    sequences are left out. Works on a batch as well.
    """
    clean = stream.withColumn("__seq", records.cleaned(F.col(seq))).filter(F.col("__seq") != "")
    keyed = clean.withColumn("input_id", records.content_id(F.col("__seq"))).drop("__seq")
    if not stream.isStreaming:
        return keyed.dropDuplicates(["input_id"])
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["input_id"])


def joined_to_groups(stream: DataFrame, group_of: DataFrame, key: str) -> DataFrame:
    """Arrivals with their group, null for none; ``group_of`` is a table, read anew by each batch."""
    return stream.join(group_of, key, "left")
