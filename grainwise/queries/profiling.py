"""Profiles, keys, versions, roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.operators import profile
from grainwise.queries.base import CLEAN_CTE, DIRTY, DIRTY_SQL, Tables, cls, dirty_events, query, rounded, txt

TEXT_COLUMNS = [n for n in DIRTY if n != "event_id"]


def _classes_sql(kind: str) -> str:
    """Per column: counts per class and what follows from them."""
    parts = []
    for i, name in enumerate(DIRTY):
        c = f"CASE WHEN {name} IS NOT NULL THEN 'number' END" if name == "event_id" else cls(name)
        raw = "CAST(event_id AS VARCHAR)" if name == "event_id" else name
        parts.append(
            f"SELECT '{name}' AS \"column\", {i} AS position, {c} AS class, {raw} AS raw FROM dirty"
        )
    long = " UNION ALL ".join(parts)
    return f"""
    WITH dirty AS ({DIRTY_SQL}), long AS ({long}),
    stats AS (
      SELECT "column", CAST(position AS BIGINT) AS position, count(*) AS rows,
        count(*) FILTER (class = 'date') AS date_cells, count(*) FILTER (class = 'number') AS number_cells,
        count(*) FILTER (class = 'boolean') AS boolean_cells, count(*) FILTER (class = 'text') AS text_cells,
        count(class) AS present, count(*) - count(class) AS missing,
        round((count(*) - count(class)) / count(*), 4) AS missing_rate,
        CASE WHEN count(class) = 0 THEN 'empty' WHEN count(DISTINCT class) = 1 THEN max(class) ELSE 'mixed' END
          AS inferred_type,
        count(DISTINCT CASE WHEN class IS NOT NULL THEN raw END) AS "unique"
      FROM long GROUP BY "column", position
    )
    {kind}
    """


@query("profile_types", "P1 P2 P3 P4", _classes_sql("""SELECT "column", position, rows, date_cells, number_cells,
    boolean_cells, text_cells, present, missing, missing_rate, inferred_type FROM stats"""))
def profile_types(t: Tables) -> DataFrame:
    return rounded(profile.column_stats(dirty_events(t)))


PROFILE_SQL = """SELECT "column", position, rows, missing, missing_rate, inferred_type, "unique",
    "column" IN ('event_id', 'customer_id') AND missing = 0 AND "unique" = rows AS candidate_key FROM stats"""


@query("profile_columns", "P4 P5 P7", _classes_sql(PROFILE_SQL))
def profile_columns(t: Tables) -> DataFrame:
    found = profile.column_profile(dirty_events(t))
    return rounded(found).select(
        "column", "position", "rows", "missing", "missing_rate", "inferred_type", "unique", "candidate_key"
    )


@query("profile_summary", "P11", _classes_sql("""SELECT "column", inferred_type, missing_rate, "unique",
    "column" IN ('event_id', 'customer_id') AND missing = 0 AND "unique" = rows AS candidate_key FROM stats"""))
def profile_summary(t: Tables) -> DataFrame:
    return rounded(profile.planner_summary(profile.column_profile(dirty_events(t))))


def _examples_sql() -> str:
    parts = []
    for name in TEXT_COLUMNS:
        shown = f"CASE WHEN length({name}) > 28 THEN left({name}, 27) || '…' ELSE {name} END"
        parts.append(f"SELECT DISTINCT '{name}' AS \"column\", {shown} AS example FROM dirty WHERE ({txt(name)}) IS NOT NULL")
    docs = ("SELECT DISTINCT 'text' AS \"column\", CASE WHEN length(text) > 28 THEN left(text, 27) || '…' ELSE text END "
            f"AS example FROM documents WHERE ({txt('text')}) IS NOT NULL")
    return f"""
    WITH dirty AS ({DIRTY_SQL}), long AS ({' UNION ALL '.join([*parts, docs])}),
    placed AS (SELECT "column", example, row_number() OVER (PARTITION BY "column" ORDER BY example) AS place FROM long)
    SELECT "column", example, place FROM placed WHERE place <= 3
    """


@query("profile_examples", "P6", _examples_sql())
def profile_examples(t: Tables) -> DataFrame:
    both = profile.examples(dirty_events(t), TEXT_COLUMNS).unionByName(profile.examples(t.documents, ["text"]))
    return both.withColumn("place", F.col("place").cast("bigint"))


@query("candidate_keys", "P7", """
    SELECT 'orders' AS "table", 'o_orderkey' AS "column", count(*) AS rows FROM orders
      HAVING count(*) = count(DISTINCT o_orderkey)
    UNION ALL SELECT 'orders', 'o_custkey', count(*) FROM orders HAVING count(*) = count(DISTINCT o_custkey)
    UNION ALL SELECT 'customer', 'c_custkey', count(*) FROM customer HAVING count(*) = count(DISTINCT c_custkey)
    UNION ALL SELECT 'lineitem', 'l_orderkey', count(*) FROM lineitem HAVING count(*) = count(DISTINCT l_orderkey)
    UNION ALL SELECT 'events', 'event_id', count(*) FROM events HAVING count(*) = count(DISTINCT event_id)
""")
def candidate_keys(t: Tables) -> DataFrame:
    wanted = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey"],
              "events": ["event_id"]}
    parts = [
        profile.candidate_keys(profile.column_profile(getattr(t, name), columns, keys=columns))
        .select(F.lit(name).alias("table"), "column", "rows")
        for name, columns in wanted.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("grain_suggestion", "P8", """
    SELECT CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'order_id' END AS key,
           CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'one row per order' ELSE 'no single-column key' END AS grain
    FROM orders
""")
def grain_suggestion(t: Tables) -> DataFrame:
    renamed = t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"))
    return profile.grain(profile.column_profile(renamed))


@query("dataset_version", "P9")
def dataset_version(t: Tables) -> DataFrame:
    return profile.fingerprint(t.orders, "orders").unionByName(profile.fingerprint(t.lineitem, "lineitem"))


@query("version_drift", "P10 W8", """
    WITH changed AS (
      SELECT count(*) AS n FROM (
        (SELECT * REPLACE (upper(event_type) AS event_type) FROM events EXCEPT ALL SELECT * FROM events))
    )
    SELECT 'orders' AS dataset, (SELECT count(*) FROM orders) AS bound_rows, (SELECT count(*) FROM orders) AS current_rows,
      'unchanged' AS status
    UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM events),
      CASE WHEN n > 0 THEN 'changed' ELSE 'unchanged' END FROM changed
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), NULL, 'removed'
    UNION ALL SELECT 'part', NULL, (SELECT count(*) FROM part), 'added'
""")
def version_drift(t: Tables) -> DataFrame:
    def versions(tables: dict[str, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [profile.fingerprint(df, name) for name, df in tables.items()])

    shuffled = t.orders.repartition(3, "o_custkey")  # row order must not matter
    edited = t.events.withColumn("event_type", F.upper("event_type"))
    bound = versions({"orders": t.orders, "events": t.events, "customer": t.customer})
    current = versions({"orders": shuffled, "events": edited, "part": t.part})
    return profile.version_changes(bound, current)


@query("suggested_roles", "P12", _classes_sql("""
    SELECT COALESCE(
        (SELECT min_by("column", position) FROM stats WHERE "column" IN ('event_id', 'customer_id') AND missing = 0
           AND "unique" = rows), 'event_id') AS entity,
      CAST(NULL AS VARCHAR) AS order_entity,
      (SELECT min_by("column", position) FROM stats WHERE inferred_type = 'number' AND "column" <> 'event_id') AS value,
      (SELECT min_by("column", position) FROM stats WHERE inferred_type = 'date' OR "column" = 'purchase_date') AS time,
      (SELECT min_by("column", position) FROM stats WHERE inferred_type = 'text' AND "column" <> 'event_id') AS "group",
      'status' AS status"""))
def suggested_roles(t: Tables) -> DataFrame:
    return profile.suggest_roles(profile.column_profile(dirty_events(t)))


@query("control_totals", "P14 G23", f"""
    WITH {CLEAN_CTE},
    grouped AS (SELECT region, sum(number) AS s FROM cells GROUP BY region),
    ids AS (SELECT customer_id, count(*) AS n FROM cells WHERE customer_id IS NOT NULL GROUP BY customer_id),
    copies AS (SELECT count(*) AS n FROM dirty
      GROUP BY {', '.join(f"trim({c}, ' ')" for c in ('customer_id', 'purchase_date', 'amount', 'region', 'status'))})
    SELECT (SELECT count(*) FROM cells) AS rows,
      (SELECT count(*) FROM ids) AS distinct_entities,
      (SELECT count(*) FROM ids WHERE n > 1) AS repeated_entities,
      (SELECT count(*) FROM copies WHERE n > 1) AS duplicate_row_groups,
      (SELECT round(sum(number), 4) FROM cells) AS amount_total,
      (SELECT round(sum(s), 4) FROM grouped WHERE region IS NOT NULL) AS amount_in_groups,
      (SELECT round(sum(s), 4) FROM grouped WHERE region IS NULL) AS amount_without_group,
      (SELECT count(*) FROM cells WHERE region IS NULL) AS rows_without_group,
      (SELECT count(*) FROM cells WHERE number IS NULL) AS rows_without_amount,
      TRUE AS reconciled
""")
def control_totals(t: Tables) -> DataFrame:
    return rounded(profile.control_totals(dirty_events(t).drop("event_id"), "customer_id", "amount", "region"))
