"""Queries with SQL give the same rows as DuckDB; the others give a row for each document."""

from pathlib import Path

import pytest

from grovewise.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE[name]})").fetchall()
    show = lambda rows: sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(df.select(*names).collect()) == show(want)


def test_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("p6_ids", "p8_scores"):
        assert queries.QUERIES[name](spark, SF).count() == docs.count()
    assert queries.QUERIES["p7_containers"](spark, SF).select("doc_id").distinct().count() == docs.count()
