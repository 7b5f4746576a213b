from grainwise.operators import keys


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_key_samples_neither_join_nor_count(spark):
    left = spark.createDataFrame([(1, "A "), (2, "b"), (3, None), (4, "c"), (4, "c")], "n int, k string")
    right = spark.createDataFrame([("a",), ("C",), ("d",), (None,)], "k string")
    found = keys.key_samples(left, right, [("k", "k")], 1)
    assert sorted(map(tuple, found.collect())) == [("left_orphan", "b"), ("matched", "a"), ("right_orphan", "d")]
    assert "Join" not in plan(found) and "count(" not in plan(found)
