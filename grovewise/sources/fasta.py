"""FASTA records as a table, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.operators import dereplicate
from grovewise.sources.tables import digest


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``ord``, ``id`` (first word of the header), ``header``, ``seq`` of each record.

    Files are split at ``>`` that begins a line, so one file is read by many tasks. Repeated ids stay
    repeated. A record with an empty header has the id null. ``ord`` grows with the place in the files.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", r"^>", "")
    parts = F.split(F.regexp_replace(body, "\r", ""), "\n", 2)
    rows = text.select(F.monotonically_increasing_id().alias("ord"), parts.alias("p")).filter(F.trim(F.concat_ws("", "p")) != "")
    header = F.col("p")[0]
    return rows.select("ord", F.nullif(F.regexp_extract(header, r"^\s*(\S*)", 1), F.lit("")).alias("id"), header.alias("header"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+", "").alias("seq"))


def write_inputs(records: DataFrame, path: str) -> None:
    """A folder of distinct inputs (S26, A1): ``sequences`` (FASTA, sorted by id), ``names`` (input_id, name; a table) and
    ``manifest`` (one JSON line: records, empty ones, sequences, fingerprint of ids and sequences). Refuses an existing path.

    ``records(ord, header, seq)`` as of ``read_fasta``; the sequence of the first record of a content is kept.
    """
    found = dereplicate.dereplicate(records, "seq", "ord")
    write_fasta(found, f"{path}/sequences", "input_id", "seq", ["input_id"])
    dereplicate.carriers(records, "seq", "header").write.mode("errorifexists").parquet(f"{path}/names")
    counts = dereplicate.summary(records, "seq").select("records", "empty", "sequences")
    counts.crossJoin(digest(found, ["input_id", "seq"])).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")  # one row each


def write_fasta(df: DataFrame, path: str, key: str, seq: str, order: list[str] | None = None) -> None:
    """One line a sequence, sorted by ``order`` if given (S4, S26); refuses an existing path."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)
