from grainwise.operators import joins
from grainwise.operators.joins import JoinSpec, Step


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chain_carries_no_column_for_its_salt(spark):
    lines = spark.createDataFrame([(1, 10, "x" * 50), (2, None, "y")], "id int, o int, note string")
    orders = spark.createDataFrame([(10, 5, "z")], "o int, c int, comment string")
    people = spark.createDataFrame([(5, "n")], "c int, name string")
    steps = [Step("l", "o", JoinSpec((("o", "o"),)).confirm("line")), Step("o", "p", JoinSpec((("c", "c"),)).confirm("line"))]
    joined = joins.chain({"l": lines, "o": orders, "p": people}, steps, check=False)
    assert sorted(joined.select("l__id", "matched_1", "matched_2", "p__name").collect()) == [(1, True, True, "n"), (2, False, False, None)]
    assert "__spread" not in joined.columns
    # The note is hashed once, below the joins; the second join does not hash the columns of the first again.
    hashes = [x for x in plan(joined.select("l__id", "matched_2")).splitlines() if "xxhash64" in x]
    assert not any("note" in x and "c#" in x and "comment" in x for x in hashes)
