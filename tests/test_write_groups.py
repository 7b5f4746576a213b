"""Writes folded by groups of linked tasks give the outcomes of the log replayed write by write."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainwise.operators import writes
from test_streaming_ledger import T0, WRITES, sequential, told, write_log


def classify(spark, rows, **more):
    df = spark.createDataFrame(rows, WRITES).repartition(5)
    return writes.classify_writes(df, "task", "write_key", "based_on", ["at", "n"], F.date_trunc("hour", "at"), **more)


def owner_chain(length):
    """Every owner is only known when the one before it is: a save of t1 refuses its next write, whose key t2 then saves, and so on."""
    rows = [("t0", "k0", 5)]
    for i in range(1, length):
        rows += [(f"t{i}", f"k{i - 1}", 0), (f"t{i}", f"k{i}", 0)]
    return [(*row, T0 + dt.timedelta(minutes=n), n) for n, row in enumerate(rows)]


def apart(rows):
    """Logs that share no task and no key."""
    return [(task and f"{side} {task}", key and f"{side} {key}", based, at, 10 * n + side)
            for side, part in enumerate(rows) for task, key, based, at, n in part]


def test_a_chain_of_owners_takes_no_rounds(spark, monkeypatch):
    rows = owner_chain(12)
    made, store = [], writes._stored
    monkeypatch.setattr(writes, "_stored", lambda df, name: made.append(name) or store(df, name))
    assert told(classify(spark, rows)) == sequential(rows)[0]
    assert "folded" not in made and len(made) <= 24  # 12 rounds of 5 tables before


@pytest.mark.parametrize("alone", [0, 100, 1000])
def test_small_and_large_groups_equal_the_fold(spark, alone):
    rows = apart([write_log(11, 300), owner_chain(5), write_log(12, 60)])
    assert told(classify(spark, rows, alone=alone)) == sequential(rows)[0]


def test_groups_that_stay_open_equal_the_fold(spark, monkeypatch):
    monkeypatch.setattr(writes, "HOOKS", 0)
    rows = apart([owner_chain(6), [("a", "k", 0, T0, 0), ("b", "k", 0, T0, 1), ("b", "m", 0, T0, 2)]])
    made, store = [], writes._stored
    monkeypatch.setattr(writes, "_stored", lambda df, name: made.append(name) or store(df, name))
    assert told(classify(spark, rows)) == sequential(rows)[0]
    assert "folded" in made


@pytest.mark.parametrize("alone", [0, 1000])
def test_a_snapshot_before_the_log(spark, alone):
    rows = write_log(13, 300)
    _, current, owners = sequential(rows[:150])
    out = classify(spark, rows[150:], alone=alone, revisions=spark.createDataFrame(list(current.items()), "task string, revision bigint"),
                   owners=spark.createDataFrame(list(owners.items()), "write_key string, task string"))
    assert told(out) == sequential(rows[150:], current, owners)[0]


@pytest.mark.parametrize("alone", [0, 1000])
def test_a_write_without_a_time_is_never_saved(spark, alone):
    rows = [("a", "k", 0, None, 0), ("a", "k", 0, T0, 1), ("b", "k", 0, T0, 2), ("a", None, 1, T0, 3), ("a", None, 1, T0, 4), (None, "k", 0, None, 5)]
    out = [(None, "conflict"), (0, "saved"), (0, "conflict"), (1, "saved"), (2, "conflict"), (None, "conflict")]
    assert told(classify(spark, rows, alone=alone)) == dict(enumerate(out))


def test_tasks_and_keys_may_be_structs(spark):
    rows = write_log(14, 120)
    df = spark.createDataFrame(rows, WRITES).withColumn("task", F.when(F.col("task").isNotNull(), F.struct(F.col("task"), F.lit(1)))).withColumn(
        "write_key", F.when(F.col("write_key").isNotNull(), F.array("write_key")))
    assert told(writes.classify_writes(df, "task", "write_key", "based_on", ["at", "n"], F.date_trunc("hour", "at"))) == sequential(rows)[0]
