"""Redaction, checksums, caps, plan differences, task summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.operators import audit
from grainwise.queries.base import Tables, query

CUT = "CASE WHEN length({c}) > 500 THEN left({c}, 500) || '…[truncated]' ELSE {c} END"


@query("redact_rows", "E1", f"""SELECT doc_id, {CUT.format(c='text')} AS text, lang, source, n_chars FROM documents""")
def redact_rows(t: Tables) -> DataFrame:
    """Columns named like raw data or a secret do not come out at all."""
    df = t.documents.withColumns({"api_key": F.lit("k"), "rows": F.lit(1), "Password": F.col("lang")})
    return audit.redact(df)


@query("redact_lists", "E1", """SELECT vec_id, CAST(len(embedding) AS BIGINT) AS item_count,
    CAST(CASE WHEN len(embedding) > 20 THEN 3 ELSE len(embedding) END AS BIGINT) AS kept,
    round(embedding[1]::DOUBLE, 4) AS first_item FROM embeddings""")
def redact_lists(t: Tables) -> DataFrame:
    cut = audit.redact(t.embeddings)
    return cut.select("vec_id", F.col("embedding.item_count").alias("item_count"),
                      F.size("embedding.items").cast("bigint").alias("kept"),
                      F.round(F.col("embedding.items")[0].cast("double"), 4).alias("first_item"))


@query("redact_nested", "E1", """SELECT event_id, '{"user":' || user_id || ',"note":{"kind":"' || event_type || '"}}' AS payload FROM events""")
def redact_nested(t: Tables) -> DataFrame:
    call = F.struct(F.col("user_id").alias("user"), F.col("value").alias("values"), F.struct(
        F.col("event_type").alias("kind"), F.lit("s").alias("access_token")).alias("note"))
    return audit.redact(t.events.select("event_id", call.alias("call"))).select("event_id", F.to_json("call").alias("payload"))


@query("record_checksum", "E2", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey ||
    ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS checksum FROM orders""")
def record_checksum(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderpriority", "o_orderkey", "o_orderstatus", "o_custkey")
    return audit.sealed(df).select("o_orderkey", "checksum")


@query("checksum_tampered", "E2", """SELECT o_orderstatus <> 'P' AS intact, count(*) AS rows FROM orders GROUP BY 1""")
def checksum_tampered(t: Tables) -> DataFrame:
    """Seal, change one status, verify."""
    sealed = audit.sealed(t.orders.select("o_orderkey", "o_orderstatus"))
    changed = sealed.withColumn("o_orderstatus", F.regexp_replace("o_orderstatus", "P", "F"))
    return audit.seal_checks(changed).groupBy("intact").agg(F.count(F.lit(1)).alias("rows"))


@query("evidence_cap", "E3", """WITH g AS (SELECT l_partkey AS key, sum(l_quantity) AS value FROM lineitem GROUP BY 1)
    SELECT key, value, (SELECT count(*) FROM g) AS group_count, (SELECT count(*) FROM g) > 100 AS truncated FROM g
    ORDER BY value DESC, key LIMIT 100""")
def evidence_cap(t: Tables) -> DataFrame:
    groups = t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(F.sum("l_quantity").alias("value"))
    return audit.capped_groups(groups, [F.col("value").desc(), F.col("key").asc()])


FROZEN = """SELECT event_id, user_id, CASE WHEN event_type = 'purchase' AND value > 120 THEN 'COMPLETED' ELSE 'PLANNING' END
    AS state, ts FROM events"""


@query("frozen_events", "E4", f"""WITH s AS ({FROZEN}), d AS (SELECT user_id, max(ts) FILTER (state = 'COMPLETED') AS done FROM s
      GROUP BY 1) SELECT event_id, done IS NOT NULL AS closed FROM s JOIN d USING (user_id) WHERE done IS NULL OR ts <= done""")
def frozen_events(t: Tables) -> DataFrame:
    state = F.when((F.col("event_type") == "purchase") & (F.col("value") > 120), F.lit("COMPLETED")).otherwise(F.lit("PLANNING"))
    log = t.events.select("event_id", "user_id", state.alias("state"), "ts")
    return audit.frozen_events(log, "user_id", "state", "ts").select(
        "event_id", F.col("completed_at").isNotNull().alias("closed"))


FIRST = "SELECT event_id AS plan, event_type AS analysis, CAST(user_id AS STRING) AS entity, NULL AS value_field FROM events"
STAGES = [
    ("decision", "event_type", "CAST(user_id AS STRING)", "CASE WHEN value < 50 THEN 'amount' END"),
    ("compiled", "CASE WHEN event_type = 'error' THEN 'unsupported' ELSE event_type END", "CAST(user_id AS STRING)",
     "CASE WHEN value < 50 THEN 'amount' END"),
    ("guarded", "CASE WHEN event_type = 'error' THEN 'unsupported' ELSE event_type END",
     "CASE WHEN value > 100 THEN NULL ELSE CAST(user_id AS STRING) END", "CASE WHEN value < 40 THEN 'amount' END"),
]


def _diff_sql() -> str:
    parts = []
    for (_, *before), (name, *after) in zip(STAGES, STAGES[1:]):
        for field, b, a in zip(("analysis", "entity", "value_field"), before, after):
            parts.append(f"SELECT event_id AS plan, '{name}' AS stage, '{field}' AS field, {b} AS before, {a} AS after FROM events "
                         f"WHERE ({b}) IS DISTINCT FROM ({a})")
    return " UNION ALL ".join(parts)


@query("plan_diff", "E5", _diff_sql())
def plan_diff(t: Tables) -> DataFrame:
    stages = audit.union_all([
        t.events.selectExpr("event_id AS plan", f"'{name}' AS stage", f"{a} AS analysis", f"{e} AS entity", f"{v} AS value_field")
        for name, a, e, v in STAGES
    ])
    return audit.plan_changes(stages, "plan", "stage", [s[0] for s in STAGES], ["analysis", "entity", "value_field"])


TOOL = "CASE WHEN value < 30 THEN 'profile_dataset' WHEN value < 70 THEN 'execute_metric' ELSE 'validate_result' END"


@query("task_summary", "E7", f"""WITH c AS (SELECT user_id, {TOOL} AS tool, event_type AS status, count(*) AS n FROM events GROUP BY ALL),
    l AS (SELECT user_id, sum(n)::BIGINT AS calls, string_agg(tool || '/' || status || '/' || n, ',' ORDER BY tool, status) AS tools
      FROM c GROUP BY 1)
    SELECT user_id, count(*) AS events, max_by(event_type, ts) AS state, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, any_value(calls) AS calls, any_value(tools) AS tools
    FROM events JOIN l USING (user_id) GROUP BY user_id""")
def task_summary(t: Tables) -> DataFrame:
    calls = t.events.selectExpr("user_id", f"{TOOL} AS tool", "event_type AS status")
    found = audit.task_summary(calls, t.events.withColumnRenamed("event_type", "state"), "user_id", "ts")
    line = F.transform("tools", lambda s: F.concat_ws("/", s["tool"], s["status"], s["n"].cast("string")))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return found.select("user_id", "events", "state", F.date_format("started_at", stamp).alias("started_at"),
                        F.date_format("updated_at", stamp).alias("updated_at"), "calls",
                        F.array_join(line, ",").alias("tools"))
