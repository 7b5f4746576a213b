"""Counters, alerts, writes, transitions and budgets over the events table.

The batch side of the streaming operators, so that SQL can check them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.operators import ledger, writes
from grainwise.queries.base import Tables, query
from grainwise.session import scratch_path
from grainwise.streaming import alerts, replay, upserts, windows


@query("rate_window", "T1", """WITH c AS (SELECT event_type AS route, CAST(user_id AS VARCHAR) AS subject,
      date_trunc('day', ts) AS w, count(*) AS requests FROM events GROUP BY ALL)
    SELECT route, subject, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, requests,
      greatest(0, 2 - requests) AS remaining, greatest(0, requests - 2) AS refused, requests > 2 AS exceeded FROM c""")
def rate_window(t: Tables) -> DataFrame:
    counts = windows.request_counts(t.events, "ts", F.col("event_type"), F.col("user_id").cast("string"), "1 day")
    return windows.with_limit(counts, 2).select(
        "route", "subject", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
        "remaining", "refused", "exceeded")


@query("rate_expired", "T6", """WITH c AS (SELECT event_type AS route, CAST(user_id AS VARCHAR) AS subject,
      date_trunc('hour', ts) AS w, count(*) AS requests FROM events GROUP BY ALL)
    SELECT route, subject, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, requests FROM c
    WHERE w + INTERVAL 1 HOUR < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 DAY""")
def rate_expired(t: Tables) -> DataFrame:
    counts = windows.request_counts(t.events, "ts", F.col("event_type"), F.col("user_id").cast("string"), "1 hour")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return ledger.expired(counts, "reset_at", now).select(
        "route", "subject", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests")


PARTS = 3
# A time without a zone as the instant it names in UTC, which watermarks need, and back.
INSTANT = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)) AS ts"
SHOWN = "date_format(timestampadd(MICROSECOND, unix_micros(window_start), TIMESTAMP_NTZ'1970-01-01 00:00:00'), 'yyyy-MM-dd HH:mm:ss') AS window_start"


def _third(t: Tables) -> Column:
    """Which third of the days of the table a row is in."""
    first, last = t.events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    days = (last - first).days + 1 if first else 1
    return F.floor(F.datediff(F.to_date("ts"), F.lit(first)) * PARTS / days)


@query("rate_window_stream", "T1", """WITH c AS (SELECT event_type AS route, CAST(user_id AS VARCHAR) AS subject,
      date_trunc('day', ts) AS w, count(*) AS requests FROM events GROUP BY ALL)
    SELECT route, subject, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, requests,
      greatest(0, 2 - requests) AS remaining, greatest(0, requests - 2) AS refused, requests > 2 AS exceeded FROM c""")
def rate_window_stream(t: Tables) -> DataFrame:
    """Counters as they stand after every micro-batch; a counter leaves the state a day after its window."""
    out = scratch_path(t.spark, "counters")

    def start(rows: DataFrame, checkpoint: str):
        counts = windows.request_counts(rows, "ts", F.col("event_type"), F.col("user_id").cast("string"), "1 day", late="1 day")
        return counts.writeStream.outputMode("update").foreachBatch(replay.collected(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    replay.in_parts(t.events.select(F.expr(INSTANT), "event_type", "user_id", _third(t).alias("part")), F.col("part"), PARTS, start)
    last = t.spark.read.parquet(out).groupBy("route", "subject", "window_start").agg(F.max("requests").alias("requests"))
    return windows.with_limit(last, 2).selectExpr("route", "subject", SHOWN, "requests", "remaining", "refused", "exceeded")


@query("rate_expired_stream", "T6", """WITH c AS (SELECT event_type AS route, CAST(user_id AS VARCHAR) AS subject,
      date_trunc('hour', ts) AS w, count(*) AS requests FROM events GROUP BY ALL)
    SELECT route, subject, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, requests FROM c
    WHERE w + INTERVAL 1 HOUR <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY""")
def rate_expired_stream(t: Tables) -> DataFrame:
    """Counters that the watermark, a day behind the newest request, has taken out of the state."""
    out = scratch_path(t.spark, "expired")

    def start(rows: DataFrame, checkpoint: str):
        counts = windows.request_counts(rows, "ts", F.col("event_type"), F.col("user_id").cast("string"), "1 hour", late="1 day")
        return counts.writeStream.outputMode("append").foreachBatch(replay.collected(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    replay.in_parts(t.events.select(F.expr(INSTANT), "event_type", "user_id", _third(t).alias("part")), F.col("part"), PARTS, start)
    return t.spark.read.parquet(out).selectExpr("route", "subject", SHOWN, "requests")


# A service is the last digit of the user id, a monitoring cycle a quarter of a day.
CYCLE = "concat(CAST(CAST(ts AS DATE) AS STRING), ' ', CASE WHEN hour(ts) < 6 THEN '00' WHEN hour(ts) < 12 THEN '06' " \
        "WHEN hour(ts) < 18 THEN '12' ELSE '18' END)"
SERVICE = "right(CAST(user_id AS STRING), 1)"

ALERT_CTE = f"""raw AS (SELECT {SERVICE} AS service, {CYCLE} AS cycle, * FROM events),
    cyc AS (SELECT service, cycle, count(*) FILTER (event_type = 'signup' AND value > 60) = 0 AS monitor_ok,
      count(*) FILTER (event_type = 'purchase' AND value > 150) = 0 AS site_ok,
      coalesce(list_sort(list_distinct(list(user_id) FILTER (event_type = 'error' AND value > 60))), []) AS keys
      FROM raw GROUP BY service, cycle),
    a AS (SELECT *, last_value(CASE WHEN monitor_ok THEN keys END IGNORE NULLS) OVER before AS known,
      sum(monitor_ok::INT) OVER upto AS run FROM cyc
      WINDOW before AS (PARTITION BY service ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        upto AS (PARTITION BY service ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT *, CASE WHEN NOT monitor_ok THEN 'monitor_failed' WHEN NOT site_ok THEN 'site_down'
        WHEN len(keys) > 0 THEN 'errors' ELSE 'healthy' END AS kind,
      CASE WHEN monitor_ok THEN [] ELSE [] END AS nothing FROM a),
    c AS (SELECT *, sum((kind = 'monitor_failed')::INT) OVER (PARTITION BY service, run ORDER BY cycle
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS failures,
      coalesce(sum((kind = 'healthy')::INT) OVER (PARTITION BY service ORDER BY cycle
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM b),
    d AS (SELECT *, CASE WHEN kind = 'monitor_failed' AND failures >= 2 THEN 'monitor' WHEN kind = 'site_down' THEN 'site'
        WHEN kind = 'errors' THEN 'errors' END AS trig FROM c),
    e AS (SELECT *, first_value(trig IGNORE NULLS) OVER w AS opener, coalesce(bool_or(trig = 'site') OVER w, FALSE) AS site_before,
      len(list_filter(keys, lambda x: NOT list_contains(coalesce(known, []), x))) AS fresh
      FROM d WINDOW w AS (PARTITION BY service, episode ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, opener IS NOT NULL AS degraded, site_before OR coalesce(opener = 'monitor', FALSE) AS severe FROM e),
    h AS (SELECT *, trig IS NOT DISTINCT FROM 'monitor' AND NOT degraded AS m1, kind = 'site_down' AND (NOT degraded OR NOT severe)
      AS s1, kind = 'errors' AND (NOT degraded OR fresh > 0) AS e1, kind = 'healthy' AND degraded AS r1 FROM g)"""


ALERT_SQL = f"""WITH {ALERT_CTE} SELECT service, cycle, kind,
    CASE WHEN kind = 'healthy' THEN 'healthy' WHEN degraded OR trig IS NOT NULL THEN 'degraded' ELSE 'healthy' END AS phase,
    CASE WHEN kind = 'monitor_failed' THEN failures ELSE 0 END::BIGINT AS failures,
    CASE WHEN m1 THEN 'failure' WHEN s1 OR e1 THEN CASE WHEN degraded THEN 'failure_update' ELSE 'failure' END
      WHEN r1 THEN 'recovery' END AS notification,
    CASE WHEN m1 OR s1 THEN 'P1' WHEN e1 THEN 'P2' WHEN r1 THEN CASE WHEN severe THEN 'P1' ELSE 'P2' END END AS severity,
    CASE WHEN m1 THEN 'monitor_failed_twice' WHEN s1 THEN 'site_unavailable' WHEN e1 THEN 'worker_error'
      WHEN r1 THEN 'site_healthy_no_active_errors' END AS reason FROM h"""


def _observed(t: Tables) -> tuple[DataFrame, DataFrame]:
    raw = t.events.selectExpr(f"{SERVICE} AS service", f"{CYCLE} AS cycle", "event_type", "value", "user_id")
    cycles = raw.groupBy("service", "cycle").agg(
        (F.count_if((F.col("event_type") == "signup") & (F.col("value") > 60)) == 0).alias("monitor_ok"),
        (F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 150)) == 0).alias("site_ok"))
    errors = raw.filter("event_type = 'error' AND value > 60").select("service", "cycle", F.col("user_id").alias("key"))
    return cycles, errors


@query("alert_transitions", "T2", ALERT_SQL)
def alert_transitions(t: Tables) -> DataFrame:
    return alerts.batch(*_observed(t)).drop("active_keys", "new_keys")


@query("alert_transitions_stream", "T2", ALERT_SQL)
def alert_transitions_stream(t: Tables) -> DataFrame:
    """The same from a stream that keeps at most four cycles per service."""
    cycles, errors = _observed(t)
    keys = errors.groupBy("service", "cycle").agg(F.collect_set("key").alias("keys"))
    seen = cycles.join(keys, ["service", "cycle"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>"))).withColumn("ts", F.col("cycle").substr(1, 10))
    out, state = scratch_path(t.spark, "alerts"), scratch_path(t.spark, "alert-state")
    replay.in_parts(seen, _third(t), PARTS, lambda rows, checkpoint: alerts.stream(rows.drop("ts"), replay.collected(out), state, checkpoint))
    return t.spark.read.parquet(out).drop("active_keys", "new_keys", "batch")


# Every write of a user names a revision that grows by one with every third write, some early, some late. Two users share their keys.
BASED = "greatest(0, CAST(floor((n - 1) / 3) AS BIGINT) + CASE WHEN value > 90 THEN 1 WHEN value < 6 THEN -1 ELSE 0 END)"
KEY = "concat(CAST(user_id - user_id % 2 AS STRING), ' ', props, ' ', event_type, ' ', CAST(CAST(floor(value / 5) AS BIGINT) AS STRING))"
WRITE_CTE = f"""RECURSIVE log AS (SELECT event_id, user_id, user_id - user_id % 2 AS pair, {KEY} AS write_key, {BASED} AS based_on, row_number() OVER (
      PARTITION BY user_id - user_id % 2 ORDER BY ts, event_id) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)),
    replay AS (SELECT pair, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS current_revision, '' AS outcome, CAST(0 AS BIGINT) AS even,
        CAST(0 AS BIGINT) AS odd, MAP {{}}::MAP(VARCHAR, BIGINT) AS keys FROM (SELECT DISTINCT pair FROM log)
      UNION ALL
      SELECT pair, place, event_id, rev, told, even + CASE WHEN told = 'saved' AND user_id % 2 = 0 THEN 1 ELSE 0 END, odd + CASE WHEN told = 'saved' AND user_id % 2 = 1 THEN 1 ELSE 0 END,
        CASE WHEN told = 'saved' THEN map_concat(keys, MAP {{write_key: user_id}}) ELSE keys END
      FROM (SELECT log.pair, log.place, log.event_id, log.user_id, log.write_key, even, odd, keys, CASE WHEN log.user_id % 2 = 0 THEN even ELSE odd END AS rev,
          CASE WHEN keys[log.write_key] IS NOT NULL THEN CASE WHEN keys[log.write_key] = log.user_id THEN 'replayed' ELSE 'conflict' END
            WHEN log.based_on = CASE WHEN log.user_id % 2 = 0 THEN even ELSE odd END THEN 'saved' ELSE 'conflict' END AS told
        FROM replay JOIN log ON log.pair = replay.pair AND log.place = replay.place + 1)),
    outc AS (SELECT log.event_id, user_id, based_on, current_revision, outcome FROM replay JOIN log USING (event_id))"""


def _writes(t: Tables) -> DataFrame:
    """The log; places within a user come from one sort per user."""
    numbered = t.events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return numbered.selectExpr("event_id", "user_id", "ts", f"{KEY} AS write_key", f"{BASED} AS based_on")


def _outcomes(t: Tables) -> DataFrame:
    return writes.classify_writes(_writes(t), "user_id", "write_key", "based_on", ["ts", "event_id"], F.date_trunc("month", "ts"))


@query("write_outcomes", "T3", f"WITH {WRITE_CTE} SELECT event_id, user_id, based_on, current_revision, outcome FROM outc")
def write_outcomes(t: Tables) -> DataFrame:
    return _outcomes(t).select("event_id", "user_id", "based_on", "current_revision", "outcome")


@query("upsert_latest", "T3", f"""WITH {WRITE_CTE} SELECT user_id, max(based_on) + 1 AS stored_revision,
    max_by(event_id, based_on) AS event_id FROM outc WHERE outcome = 'saved' GROUP BY user_id""")
def upsert_latest(t: Tables) -> DataFrame:
    return writes.latest_snapshots(_outcomes(t), "user_id", "based_on", ["event_id"])


@query("write_outcomes_stream", "T3", f"WITH {WRITE_CTE} SELECT event_id, user_id, based_on, current_revision, outcome FROM outc")
def write_outcomes_stream(t: Tables) -> DataFrame:
    """The same from a stream that keeps one revision per task and the keys of a month."""
    log = _writes(t).withColumnsRenamed({"user_id": "task", "ts": "at"})
    out, state = scratch_path(t.spark, "outcomes"), scratch_path(t.spark, "write-state")
    named = log.withColumn("ts", F.col("at"))
    replay.in_parts(named, _third(t), PARTS, lambda rows, checkpoint: upserts.stream(
        rows.drop("ts"), replay.collected(out), state, checkpoint, ["at", "event_id"], "month", keep="60 days"))
    return t.spark.read.parquet(out).select("event_id", F.col("task").alias("user_id"), "based_on", "current_revision", "outcome")


STATE = "CASE event_type WHEN 'view' THEN 'PLANNING' WHEN 'click' THEN 'READY_TO_EXECUTE' WHEN 'signup' THEN " \
        "'NEEDS_APPROVAL' WHEN 'purchase' THEN 'EXECUTING' ELSE 'FAILED' END"


def _valid_sql() -> str:
    cases = " ".join(
        f"WHEN '{state}' THEN state IN ({', '.join(repr(x) for x in targets)})"
        for state, targets in ledger.TRANSITIONS.items()
    )
    return f"CASE WHEN from_state IS NULL THEN state IN ('IDLE', 'DATA_PROFILED') ELSE CASE from_state {cases} END END"


@query("transition_validity", "T4", f"""WITH s AS (SELECT event_id, user_id, {STATE} AS state, lag({STATE}) OVER (
      PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
    SELECT event_id, from_state, state, {_valid_sql()} AS valid FROM s""")
def transition_validity(t: Tables) -> DataFrame:
    log = t.events.selectExpr("event_id", "user_id", "ts", f"{STATE} AS state")
    checked = ledger.check_transitions(log, "user_id", "state", ["ts", "event_id"], F.to_date("ts"))
    return checked.select("event_id", "from_state", "state", "valid")


CALLS = "CASE WHEN value > 3 THEN CAST(floor(value) AS INT) END"


@query("call_ledger", "T5", f"""WITH c AS (SELECT {CALLS} AS i, CASE WHEN value < 90 THEN CAST(n AS INT) END AS o
      FROM (SELECT *, length(props) AS n FROM events))
    SELECT least(count(*), 20) AS reserved, greatest(0, 20 - count(*)) AS remaining, greatest(0, count(*) - 20) AS refused,
      count(*) AS recorded, sum(i)::BIGINT AS known_input_tokens, sum(o)::BIGINT AS known_output_tokens,
      count(*) FILTER (i IS NULL OR o IS NULL) AS unknown_usage_calls FROM c""")
def call_ledger(t: Tables) -> DataFrame:
    calls = t.events.selectExpr(f"{CALLS} AS i", "CASE WHEN value < 90 THEN CAST(length(props) AS INT) END AS o")
    return ledger.call_budget(calls, "i", "o")


@query("calls_granted", "T5", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 20")
def calls_granted(t: Tables) -> DataFrame:
    return ledger.granted_calls(t.events, ["ts", "event_id"]).select("event_id", "user_id")


@query("owner_scoped", "T7", """WITH owners AS (SELECT c_custkey, sha256('owner:' || c_name) AS owner_hash FROM customer)
    SELECT o_orderkey, o_custkey FROM orders JOIN owners ON o_custkey = c_custkey
    AND owner_hash = sha256('owner:' || 'Customer#' || lpad(CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) ELSE '0' END,
      9, '0'))""")
def owner_scoped(t: Tables) -> DataFrame:
    """Finished orders are asked for by their own customer, all others by customer 0."""
    owners = t.customer.select("c_custkey", ledger.owner_hash(F.col("c_name")).alias("owner_hash"))
    asking = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise(F.lit("0"))
    subject = F.concat(F.lit("Customer#"), F.lpad(asking, 9, "0"))
    return ledger.with_owner_check(t.orders, owners, "o_custkey", "c_custkey", ledger.owner_hash(subject)).select(
        "o_orderkey", "o_custkey")
