import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from grainwise.operators import ledger, writes
from grainwise.operators.history import Carry, with_earlier
from grainwise.streaming import alerts, replay, upserts, windows

T0 = dt.datetime(2024, 1, 1)
FINE = (True, True, [])
DRILL = [  # observation, expected notification
    ((True, False, []), ("failure", "P1", "site_unavailable")), ((True, True, ["e7"]), ("failure_update", "P2", "worker_error")),
    ((True, False, ["e7"]), None), (FINE, ("recovery", "P1", "site_healthy_no_active_errors")), (FINE, None),
    ((False, True, []), None), (FINE, None), ((True, True, ["e1", "e2"]), ("failure", "P2", "worker_error")),
    ((True, True, ["e2"]), None), ((True, True, ["e1", "e2"]), ("failure_update", "P2", "worker_error")),
    ((False, False, []), None), ((True, False, []), ("failure_update", "P1", "site_unavailable")),
    (FINE, ("recovery", "P1", "site_healthy_no_active_errors")),
]
OBSERVED = "service string, cycle timestamp, monitor_ok boolean, site_ok boolean, keys array<string>"


def batch_frames(spark, rows):
    df = spark.createDataFrame(rows, OBSERVED)
    cycles = df.select("service", "cycle", "monitor_ok", "site_ok")
    return cycles, df.select("service", "cycle", F.explode("keys").alias("key"))


def notes(df):
    return {(r.service, r.cycle): (r.phase, r.notification, r.severity, r.reason) for r in df.collect()}


def walk(rows):
    """The rules one by one, each looking back over the cycles of its service."""
    out = {}
    for service in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == service), key=lambda r: r[0])
        for i, (cycle, ok, site, keys) in enumerate(mine):
            since = max([j + 1 for j in range(i) if mine[j][1] and mine[j][2] and not mine[j][3]], default=0)
            causes = [cause(mine, j) for j in range(since, i)]
            open_now, here = any(causes), cause(mine, i)
            first = next((c for c in causes if c), None)
            severe = first == "monitor" or "site" in causes
            last = next((set(r[3]) for r in reversed(mine[:i]) if r[1]), set())
            note = (None, None, None)
            kind = "failure_update" if open_now else "failure"
            if here == "monitor" and not open_now:
                note = ("failure", "P1", "monitor_failed_twice")
            elif here == "site" and not (open_now and severe):
                note = (kind, "P1", "site_unavailable")
            elif here == "errors" and not (open_now and set(keys) <= last):
                note = (kind, "P2", "worker_error")
            elif ok and site and not keys and open_now:
                note = ("recovery", "P1" if severe else "P2", "site_healthy_no_active_errors")
            fine = ok and site and not keys
            out[(service, cycle)] = ("degraded" if not fine and (open_now or here) else "healthy", *note)
    return out


def cause(mine, i):
    """What is wrong in a cycle: the monitor failed twice in a row, the site is down, or there are errors."""
    _, ok, site, keys = mine[i]
    if not ok:
        return "monitor" if i and not mine[i - 1][1] else None
    return "site" if not site else "errors" if keys else None


def random_rows(n_services=6, n=60):
    random.seed(3)
    rows = []
    for s in range(n_services):
        for i in range(n):
            keys = random.sample(["a", "b", "c"], random.choice([0, 0, 1, 2]))
            rows.append((f"s{s}", T0 + dt.timedelta(hours=i), random.random() > 0.3, random.random() > 0.15, keys))
    return rows


def test_alert_drill(spark):
    rows = [("web", T0 + dt.timedelta(hours=i), *o) for i, (o, _) in enumerate(DRILL)]
    expected = [n or (None, None, None) for _, n in DRILL]
    assert [v[1:] for v in walk(rows).values()] == expected
    got = notes(alerts.batch(*batch_frames(spark, rows)))
    assert [got[("web", T0 + dt.timedelta(hours=i))][1:] for i in range(len(DRILL))] == expected
    assert got[("web", rows[-1][1])][0] == "healthy"


def test_alert_batch_equals_the_rules(spark):
    rows = random_rows()
    assert notes(alerts.batch(*batch_frames(spark, rows))) == walk(rows)


@pytest.mark.parametrize("cuts", [[20], [1, 2, 3, 5, 13, 14, 30]])
def test_alert_stream_equals_the_batch(spark, tmp_path, cuts):
    """Several micro-batches, between which at most four cycles of a service are kept."""
    rows = random_rows(4, 40)
    frame = spark.createDataFrame(rows, OBSERVED)
    hour = F.timestamp_diff("HOUR", F.lit(T0), F.col("cycle"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    replay.in_parts(frame, sum(((hour >= c).cast("int") for c in cuts), F.lit(0)), len(cuts) + 1,
                    lambda stream, checkpoint: alerts.stream(stream, replay.collected(out), state, checkpoint))
    assert notes(spark.read.parquet(out)) == walk(rows)
    for side in ("0", "1"):
        assert spark.read.parquet(f"{state}/cycles-{side}").groupBy("service").count().agg(F.max("count")).first()[0] <= 4


def test_request_window_on_batch_and_stream(spark, tmp_path):
    rows = [("a", "u", T0 + dt.timedelta(seconds=s)) for s in range(0, 130, 3)] + [("b", "v", T0 + dt.timedelta(seconds=200))]
    schema = "route string, subject string, at timestamp"
    df = spark.createDataFrame(rows, schema)
    batch = windows.with_limit(windows.request_counts(df, "at", F.col("route"), F.col("subject")), 15)
    got = {(r.route, r.window_start): (r.requests, r.remaining, r.refused, r.exceeded) for r in batch.collect()}
    assert got[("a", T0)] == (20, 0, 5, True)
    assert got[("a", T0 + dt.timedelta(minutes=2))] == (4, 11, 0, False)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = windows.request_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at", F.col("route"),
                                    F.col("subject"), late="10 seconds")
    query = (counts.writeStream.format("memory").queryName("counts").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert query.awaitTermination(120)
    # windows that ended before the watermark (190 s) have left the state
    assert {(r.route, r.requests) for r in spark.table("counts").collect()} == {("a", 20), ("a", 4)}


def sequential(rows, revisions=None, owners=None):
    """Compare-and-set, write by write: the rule the chunked form must reproduce."""
    current, owner, out = dict(revisions or {}), dict(owners or {}), {}
    for task, key, based_on, at, n in sorted(rows, key=lambda r: (r[3], r[4])):
        now = current.get(task, 0)
        if task is None:
            out[n] = (None, "conflict")
        elif key is not None and key in owner:
            out[n] = (now, "replayed" if owner[key] == task else "conflict")
        elif based_on == now:
            out[n] = (now, "saved")
            current[task] = now + 1
            if key is not None:
                owner[key] = task
        else:
            out[n] = (now, "conflict")
    return out, current, owner


def write_log(seed, n=700):
    """A third of all writes hit one task; keys come back, after saves and after conflicts, for the same task and for others."""
    rng = random.Random(seed)
    rows, guess = [], {}
    for i in range(n):
        task = "hot" if i % 3 == 0 else f"t{rng.randrange(8)}"
        key = rng.choice(rows)[1] if rows and rng.random() < 0.25 else f"k{i}"
        based_on = max(0, guess.get(task, 0) + rng.choice([0, 0, 0, 0, -1, 1, -2]))
        guess[task] = max(guess.get(task, 0), based_on + (rng.random() < 0.7))
        if rng.random() < 0.02:
            task, key, based_on = rng.choice([(None, key, based_on), (task, None, based_on), (task, key, None)])
        rows.append((task, key, based_on, T0 + dt.timedelta(minutes=7 * (i // 2)), i))
    return rows


WRITES = "task string, write_key string, based_on bigint, at timestamp, n bigint"


def told(df):
    return {r.n: (r.current_revision, r.outcome) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_write_outcomes_equal_the_fold(spark, seed):
    rows = write_log(seed)
    df = spark.createDataFrame(rows, WRITES).repartition(5)
    out = writes.classify_writes(df, "task", "write_key", "based_on", ["at", "n"], F.date_trunc("hour", "at"))
    expected, current, _ = sequential(rows)
    assert told(out) == expected
    assert {o for _, o in expected.values()} == {"saved", "replayed", "conflict"}
    latest = {r.task: r.stored_revision for r in writes.latest_snapshots(out, "task", "based_on", ["write_key"]).collect()}
    assert latest == {t: v for t, v in current.items() if v}


def test_a_key_is_taken_by_its_save_not_by_its_first_use(spark):
    rows = [("a", "k", 5, T0, 0), ("b", "k", 0, T0, 1), ("a", "k", 0, T0, 2), ("a", "m", 0, T0, 3), ("b", "k", 1, T0, 4), ("b", "m", 1, T0, 5), ("b", "p", 1, T0, 6)]
    out = writes.classify_writes(spark.createDataFrame(rows, WRITES), "task", "write_key", "based_on", ["at", "n"], F.col("n"))
    assert [o for _, (_, o) in sorted(told(out).items())] == ["conflict", "saved", "conflict", "saved", "replayed", "conflict", "saved"]


def test_writes_go_on_from_a_snapshot(spark):
    rows = write_log(5, 300)
    first, current, owners = sequential(rows[:150])
    second, _, _ = sequential(rows[150:], current, owners)
    out = writes.classify_writes(
        spark.createDataFrame(rows[150:], WRITES), "task", "write_key", "based_on", ["at", "n"], F.date_trunc("day", "at"),
        spark.createDataFrame(list(current.items()), "task string, revision bigint"), spark.createDataFrame(list(owners.items()), "write_key string, task string"))
    assert told(out) == second
    empty = spark.createDataFrame([], WRITES)
    assert writes.classify_writes(empty, "task", "write_key", "based_on", ["at", "n"], F.col("n")).count() == 0


def test_write_stream_equals_the_fold(spark, tmp_path):
    """Three micro-batches, each a run of its own that resumes from the checkpoint."""
    rows = write_log(7, 360)
    out = str(tmp_path / "out")
    frame = spark.createDataFrame(rows, WRITES)
    replay.in_parts(frame, F.floor(F.col("n") / 120), 3, lambda stream, checkpoint: upserts.stream(
        stream, replay.collected(out), str(tmp_path / "state"), checkpoint, ["at", "n"]))
    expected, current, owners = sequential(rows)
    assert told(spark.read.parquet(out)) == expected
    assert dict(spark.read.parquet(str(tmp_path / "state" / "revisions-0")).filter("task IS NOT NULL AND revision IS NOT NULL").collect()) == {t: v for t, v in current.items() if v}
    assert {(r.write_key, r.task) for r in spark.read.parquet(str(tmp_path / "state" / "owners-0")).collect()} == set(owners.items())


def test_old_keys_are_forgotten(spark, tmp_path):
    rows = [("a", "k", 0, T0, 0), ("a", "m", 1, T0 + dt.timedelta(days=9), 1), ("a", "k", 2, T0 + dt.timedelta(days=9), 2), ("a", "m", 3, T0 + dt.timedelta(days=10), 3)]
    out = str(tmp_path / "out")
    replay.in_parts(spark.createDataFrame(rows, WRITES), F.col("n"), 4, lambda stream, checkpoint: upserts.stream(
        stream, replay.collected(out), str(tmp_path / "state"), checkpoint, ["at", "n"], keep="7 days"))
    assert [o for _, (_, o) in sorted(told(spark.read.parquet(out)).items())] == ["saved", "saved", "saved", "replayed"]


def test_history_equals_plain_window(spark):
    df = spark.range(4000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 41).alias("k"),
        F.hash("id").alias("v"), F.when(F.hash("id") % 2 == 0, F.hash("id")).alias("w")).repartition(7)
    got = with_earlier(df, ["k"], F.floor(F.col("n") / 100), ["n"], [
        Carry("last_v", "last", F.col("v")), Carry("max_v", "max", F.col("v")), Carry("sum_v", "sum", F.col("v")),
        Carry("last_even", "last", F.col("w"), where=F.col("w").isNotNull())])
    rows = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.lag("v").over(Window.partitionBy("k").orderBy("n")).alias("last_v"),
                     F.max("v").over(rows).alias("max_v"), F.sum("v").over(rows).alias("sum_v"),
                     F.last("w", ignorenulls=True).over(rows).alias("last_even"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rows_without_key_have_no_history(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 1, 2), ("a", 1, 1), ("a", 2, 2)], "k string, c int, n int")
    got = with_earlier(df, ["k"], F.col("c"), ["n"], [Carry("p", "last", F.col("n"))])
    assert sorted(((r.k or ""), r.n, r.p) for r in got.collect()) == [("", 1, None), ("", 2, None), ("a", 1, None), ("a", 2, 1)]


def test_transitions(spark):
    states = ["IDLE", "DATA_PROFILED", "PLANNING", "NEEDS_APPROVAL", "READY_TO_EXECUTE", "EXECUTING", "VALIDATING",
              "COMPLETED", "EXECUTING"]
    df = spark.createDataFrame([("t", s, i) for i, s in enumerate(states)] + [("u", "PLANNING", 0)], "task string, state string, n int")
    out = ledger.check_transitions(df, "task", "state", ["n"], F.floor(F.col("n") / 2))
    bad = [(r.task, r.from_state, r.state) for r in out.filter("NOT valid").collect()]
    assert sorted(bad) == [("t", "COMPLETED", "EXECUTING"), ("u", None, "PLANNING")]
    assert len(ledger.TRANSITIONS) == 14


def test_budget(spark):
    df = spark.createDataFrame([(i, 10 if i % 2 else None, 5) for i in range(25)], "n int, i int, o int")
    row = ledger.call_budget(df, "i", "o").first()
    assert (row.reserved, row.remaining, row.refused, row.known_input_tokens, row.unknown_usage_calls) == (20, 0, 5, 120, 13)
    assert [r.n for r in ledger.granted_calls(df, ["n"]).collect()] == list(range(20))


def test_owner_scope(spark):
    rows = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "id string")
    owners = spark.createDataFrame([("t1", "alice"), ("t2", "bob")], "task string, who string").select(
        "task", ledger.owner_hash(F.col("who")).alias("owner_hash"))
    mine = spark.range(1).select(ledger.owner_hash(F.lit("alice"))).first()[0]
    assert [r.id for r in ledger.visible_to_owner(rows, owners, "id", "task", mine).collect()] == ["t1"]


def test_expiry(spark):
    df = spark.createDataFrame([(T0,), (T0 + dt.timedelta(days=3),)], "ends timestamp")
    now = F.lit(T0 + dt.timedelta(days=3, hours=1))
    assert ledger.expired(df, "ends", now).count() == 1
