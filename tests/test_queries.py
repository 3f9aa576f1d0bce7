"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from grovewise.plans import core_problems, grouping_queries

SF = "/root/testdata/sf0.001"
QUERIES = core_problems.QUERIES | grouping_queries.QUERIES
SQL = core_problems.ORACLE | grouping_queries.ORACLE


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(found, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in found)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert shown(df.collect(), df.columns) == shown(cur.fetchall(), names)
