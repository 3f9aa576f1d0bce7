"""Typed text tables, search results, cluster files, and releases that are written once."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovewise.functions import records

KNN = T.StructType([T.StructField("query", T.StringType()), T.StructField("target", T.StringType()), T.StructField("identity", T.DoubleType())])
PLACEMENT_RESULT = T.StructType([
    T.StructField("q", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("joins", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("moved", T.BooleanType()), T.StructField("of", T.IntegerType()),
])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A tab-separated table with a header and a declared schema (S5); other columns are an error."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False, mode="FAILFAST", nullValue="")


def read_knn(spark: SparkSession, path: str) -> DataFrame:
    """Headerless search results."""
    return spark.read.csv(path, sep="\t", schema=KNN)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Seeds and hits of a cluster file: ``kind`` (S, H), ``member``, ``centroid``."""
    rows = spark.read.csv(path, sep="\t").filter(F.col("_c0").isin("S", "H"))
    return rows.select(F.col("_c0").alias("kind"), F.col("_c8").alias("member"), F.when(F.col("_c0") == "H", F.col("_c9")).otherwise(F.col("_c8")).alias("centroid"))


def read_copies(spark: SparkSession, path: str) -> DataFrame:
    """``tip``, ``copies`` of a table of members with the columns tip, size and more."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("tip", F.col("size").cast("int").alias("copies"))


def write_trees(trees: DataFrame, path: str, order: list[str]) -> None:
    """One tree a line, compressed, sorted (S14): ``trees(newick)`` and the columns of ``order``; refuses an existing path."""
    trees.orderBy(*order).select(F.col("newick").alias("value")).write.option("compression", "gzip").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Placement results of all chunks, as (query, shard, member, height); mixed chunkings are refused."""
    rows = spark.read.schema(PLACEMENT_RESULT).json(path)
    if rows.select("of").distinct().count() > 1:
        raise ValueError("results come from different chunkings")
    return rows.select(F.col("q").alias("query"), "shard", F.explode("joins").alias("member", "height"))


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Exactly the named columns, with a header, doubles as ``%.6g``, null as empty (S10, S11); refuses an existing path.

    A row needs a value: readers skip a line of nulls only."""
    if set(df.columns) != set(columns):
        raise ValueError(f"columns {df.columns} are not {columns}")
    shown = [records.short_number(F.col(c)).alias(c) if df.schema[c].dataType == T.DoubleType() else F.col(c) for c in columns]
    df.select(*shown).write.csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def digest(tables: DataFrame, columns: list[str]) -> DataFrame:
    """One row, ``digest``: a hash of all rows of some columns, whatever their order.

    Rows are hashed one by one and the hashes added up, so nothing is sorted or gathered; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 13, 25, 37)]
    return tables.agg(F.sha2(F.concat_ws(":", *parts, F.count(F.lit(1)).cast("string")), 256).alias("digest"))


def next_name(existing: list[str], kind: str, now: dt.datetime) -> str:
    """``YYYYMMDD.NN`` and the kind: the next free number of that day."""
    day = now.strftime("%Y%m%d")
    used = [int(m[1]) for n in existing if (m := re.fullmatch(rf"{day}\.(\d+)[a-z]", n))]
    return f"{day}.{max(used, default=0) + 1:02d}{kind}"


def write_release(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet under ``path`` and a table ``manifest`` of row counts (S18, S21); nothing is overwritten."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        counts.append((name, spark.read.parquet(f"{path}/{name}").count()))
    spark.createDataFrame(counts, "name string, n_rows bigint").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
