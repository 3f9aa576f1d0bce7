from grovewise.operators.snapshots import changes, current_rows


def test_current_row_is_the_latest(spark, rows):
    df = spark.createDataFrame([("r", "g", 1, 5), ("r", "g", 3, 7), ("r", "g", 3, 7), ("r", "g", None, 9), ("r", "h", None, None)], "r string, g string, at int, n int")
    assert rows(current_rows(df, ["r", "g"], "at", ["n"])) == [("r", "g", 7), ("r", "h", None)]


def test_added_removed_changed_and_gaps(spark, rows):
    data = [("a", 0, 1), ("a", 1, 1), ("a", 2, 2), ("b", 0, 1), ("b", 2, 1), ("c", 2, None), ("c", 1, None), ("d", 1, None), ("d", 2, 3), ("e", 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(data, "k string, i int, n int")
    got = rows(changes(df, "i", 2, "k", ["n"]))
    assert got == [("a", 2, "changed"), ("b", 1, "removed"), ("b", 2, "added"), ("c", 1, "added"), ("d", 1, "added"), ("d", 2, "changed"), ("e", 1, "removed")]
    assert changes(df.limit(0), "i", 2, "k", ["n"]).count() == 0
