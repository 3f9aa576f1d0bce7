import random

from pyspark.sql import functions as F

from grovewise.operators.hotkeys import top_per_key, totals_per_key

ORDER = [("n", "descending"), ("id", "ascending")]


def brute(data, k):
    best = {}
    for key, n, i in data:
        best.setdefault(key, []).append((-n if n is not None else float("inf"), i))
    return sorted((key, i) for key, v in best.items() for _, i in sorted(v)[:k])


def test_hot_key_and_spills(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.randrange(20), f"{i:05d}") for i in range(5000)]
    df = spark.createDataFrame(data, "key string, n int, id string").repartition(7)
    for table_rows in (50, 200_000):
        got = top_per_key(df, ["key"], ORDER, 3, table_rows=table_rows).select("key", "id").collect()
        assert sorted(map(tuple, got)) == brute(data, 3)


def test_nulls_ties_repeats_and_extra_columns(spark):
    data = [(None, 1, "a", 0), (None, 1, "b", 0), ("x", None, "c", 0), ("x", 2, "d", 0), ("x", 2, "d", 0), ("x", 2, "a", 1)]
    df = spark.createDataFrame(data, "key string, n int, id string, place int")
    got = top_per_key(df, ["key"], ORDER, 2).select("key", "id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, "a"), (None, "b"), ("x", "a"), ("x", "d")]))


def test_several_keys_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 6, "y"), ("b", 1, 7, "z")], "k string, g int, n int, id string")
    assert top_per_key(df, ["k", "g"], ORDER, 1).count() == 3
    empty = df.limit(0)
    assert top_per_key(empty, ["k"], ORDER, 1).count() == 0
    assert totals_per_key(empty, ["k"], n=F.count(F.lit(1))).count() == 0


def test_totals(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 4)], "k string, n int")
    assert rows(totals_per_key(df, ["k"], n=F.count("n"), s=F.sum("n"))) == [(None, 1, 4), ("a", 1, 1)]


def test_nan_and_clashing_names(spark):
    data = [("a", float("nan"), "x", 1), ("a", 1.0, "y", 2), ("a", 2.0, "z", 3), ("b", None, "q", 4), ("b", float("nan"), "p", 5)]
    df = spark.createDataFrame(data, "key string, n double, id string, __place int").withColumn("__code", F.lit(7)).withColumn("0", F.lit("s"))
    got = top_per_key(df, ["key"], ORDER, 2)
    assert got.columns == df.columns
    assert sorted((r["key"], r["id"]) for r in got.collect()) == [("a", "y"), ("a", "z"), ("b", "p"), ("b", "q")]
