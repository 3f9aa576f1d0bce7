"""The given tables, in canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.functions import ids
from grovewise.operators.snapshots import current_rows
from grovewise.storage import ship_package

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. From the first one on, tasks find this package on all executors."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_groups(spark: SparkSession, sf_dir: str, values: list[str], last_only: bool = False) -> DataFrame:
    """The current row of each group of each release: ``release``, ``group_id`` and ``values``."""
    groups = table(spark, sf_dir, "groups")
    if last_only:
        releases = table(spark, sf_dir, "releases")
        last = releases.agg(F.max_by("release", "seq_no").alias("release"))
        groups = groups.join(F.broadcast(last), "release", "left_semi")  # one row
    canonical = {"group_id": ids.group_id, "parent_id": ids.group_id, "component": ids.component_id}
    pick = [canonical[c](F.col(c)).alias(c) if c in canonical else F.col(c) for c in ("group_id", *values)]
    named = groups.select("release", "delivered_at", *pick).filter(F.col("group_id").isNotNull())
    return current_rows(named, ["release", "group_id"], "delivered_at", values)
