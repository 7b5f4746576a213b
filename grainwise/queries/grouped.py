"""Group comparison, trends, rankings, ratios, their accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions.predicates import FilterRule
from grainwise.operators import grouped
from grainwise.operators.grouped import Analysis
from grainwise.plans.retail import control_total
from grainwise.queries.base import CLEAN_CTE, Tables, dirty_events, query, rounded

HIT = FilterRule("status", "equals", "delivered")
OPEN = FilterRule("status", "not_equals", "cancelled")
COUNT = Analysis("group_compare", "count_distinct", "customer_id", group="region")
SUM = Analysis("group_compare", "sum", "customer_id", group="region", value="amount")
AVERAGE = Analysis("group_compare", "average", "customer_id", group="region", value="amount")
RATIO = Analysis("group_compare", "ratio", "customer_id", group="region", numerator=HIT, denominator=OPEN)

GROUPS = f"WITH {CLEAN_CTE}"
TAIL = "count(*) AS source_rows, count(DISTINCT customer_id) AS distinct_entities"


@query("group_count", "G1", f"""{GROUPS} SELECT region AS key, CAST(count(DISTINCT customer_id) AS DOUBLE) AS value, {TAIL},
    CAST(0 AS BIGINT) AS invalid_value_rows FROM cells WHERE region IS NOT NULL GROUP BY region""")
def group_count(t: Tables) -> DataFrame:
    return rounded(grouped.analyse(dirty_events(t), COUNT))


@query("group_sum", "G2 G15", f"""{GROUPS} SELECT region AS key, round(sum(number), 4) AS value, {TAIL},
    count(*) FILTER (number IS NULL) AS invalid_value_rows FROM cells WHERE region IS NOT NULL GROUP BY region
    HAVING sum(number) IS NOT NULL""")
def group_sum(t: Tables) -> DataFrame:
    return rounded(grouped.analyse(dirty_events(t), SUM))


@query("group_average", "G3 X1", f"""{GROUPS} SELECT region AS key,
    round(sum(number) FILTER (customer_id IS NOT NULL)
      / count(DISTINCT CASE WHEN number IS NOT NULL THEN customer_id END), 4) AS value, {TAIL},
    count(*) FILTER (number IS NULL OR customer_id IS NULL) AS invalid_value_rows
    FROM cells WHERE region IS NOT NULL GROUP BY region""")
def group_average(t: Tables) -> DataFrame:
    return rounded(grouped.analyse(dirty_events(t), AVERAGE))


RATIO_CTE = f"""{GROUPS}, scoped AS (SELECT *, coalesce(lower(status) = 'delivered', FALSE) AS hit FROM cells
    WHERE lower(status) <> 'cancelled')"""


@query("group_ratio", "G4", f"""{RATIO_CTE} SELECT region AS key,
    round(count(DISTINCT CASE WHEN hit THEN customer_id END) / count(DISTINCT customer_id), 4) AS value, {TAIL},
    CAST(0 AS BIGINT) AS invalid_value_rows, count(DISTINCT CASE WHEN hit THEN customer_id END) AS numerator,
    count(DISTINCT customer_id) AS denominator FROM scoped WHERE region IS NOT NULL GROUP BY region""")
def group_ratio(t: Tables) -> DataFrame:
    return rounded(grouped.analyse(dirty_events(t), RATIO))


@query("ratio_conflicts", "G5", f"""{RATIO_CTE} SELECT customer_id AS entity, count(DISTINCT region) > 1 AS many_groups,
    count(DISTINCT hit) > 1 AS many_outcomes, count(*) AS rows FROM scoped
    WHERE region IS NOT NULL AND customer_id IS NOT NULL GROUP BY customer_id
    HAVING count(DISTINCT region) > 1 OR count(DISTINCT hit) > 1""")
def ratio_conflicts(t: Tables) -> DataFrame:
    return grouped.conflicts(dirty_events(t), RATIO)


@query("ratio_guarded", "G4 G5", """SELECT o_orderpriority AS key,
    round(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) / count(DISTINCT o_orderkey), 4) AS value,
    count(*) AS source_rows, count(DISTINCT o_orderkey) AS distinct_entities, CAST(0 AS BIGINT) AS invalid_value_rows,
    count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS numerator,
    count(DISTINCT o_orderkey) AS denominator FROM orders GROUP BY o_orderpriority""")
def ratio_guarded(t: Tables) -> DataFrame:
    delivered = FilterRule("o_orderstatus", "equals", "f")
    wanted = Analysis("group_compare", "ratio", "o_orderkey", group="o_orderpriority", numerator=delivered)
    return rounded(grouped.guarded_ratio(t.orders, wanted))


NO_ENTITY = "CASE WHEN event_type IN ('error', 'view') THEN '' ELSE CAST(event_id AS STRING) END"


@query("ratio_zero_denominator", "G6", """SELECT event_type AS key, count(*) AS source_rows FROM events
    WHERE event_type IN ('error', 'view') GROUP BY event_type""")
def ratio_zero_denominator(t: Tables) -> DataFrame:
    df = t.events.selectExpr(f"{NO_ENTITY} AS entity", "event_type", "'x' AS status")
    wanted = Analysis("group_compare", "ratio", "entity", group="event_type", numerator=FilterRule("status", "equals", "x"))
    return grouped.zero_denominators(df, wanted)


def _trend(grain: str) -> Analysis:
    return Analysis("trend", "sum", "customer_id", time="purchase_date", grain=grain, value="amount")


def _trend_sql(label: str) -> str:
    return f"""{GROUPS} SELECT {label} AS key, round(sum(number), 4) AS value, {TAIL},
      count(*) FILTER (number IS NULL) AS invalid_value_rows FROM cells WHERE day IS NOT NULL GROUP BY 1
      HAVING sum(number) IS NOT NULL"""


@query("trend_day", "G7 G11", _trend_sql("strftime(day, '%Y-%m-%d')"))
def trend_day(t: Tables) -> DataFrame:
    return rounded(grouped.analyse(dirty_events(t), _trend("day")))


@query("trend_week", "G8 G11 X7", _trend_sql("strftime(day, '%G-W%V')"))
def trend_week(t: Tables) -> DataFrame:
    return rounded(grouped.analyse(dirty_events(t), _trend("week")))


def _native_trend_sql(label: str) -> str:
    return f"""SELECT {label} AS key, round(sum(o_totalprice), 2) AS value,
      count(*) AS source_rows, count(DISTINCT o_custkey) AS distinct_entities, CAST(0 AS BIGINT) AS invalid_value_rows
      FROM orders GROUP BY 1"""


def _native_trend(t: Tables, grain: str) -> DataFrame:
    wanted = Analysis("trend", "sum", "o_custkey", time="o_orderdate", grain=grain, value="o_totalprice")
    return rounded(grouped.analyse(t.orders, wanted), 2)


@query("trend_month", "G9", _native_trend_sql("strftime(o_orderdate, '%Y-%m')"))
def trend_month(t: Tables) -> DataFrame:
    return _native_trend(t, "month")


@query("trend_quarter", "G10", _native_trend_sql("year(o_orderdate) || '-Q' || quarter(o_orderdate)"))
def trend_quarter(t: Tables) -> DataFrame:
    return _native_trend(t, "quarter")


@query("trend_iso_week", "G8", _native_trend_sql("strftime(o_orderdate, '%G-W%V')"))
def trend_iso_week(t: Tables) -> DataFrame:
    return _native_trend(t, "week")


def _rank_sql(direction: str, n: int) -> str:
    return f"""SELECT CAST(l_partkey AS VARCHAR) AS key, round(sum(l_extendedprice), 2) AS value, count(*) AS source_rows,
      count(DISTINCT l_orderkey) AS distinct_entities, CAST(0 AS BIGINT) AS invalid_value_rows FROM lineitem
      GROUP BY l_partkey ORDER BY sum(l_extendedprice) {direction}, key LIMIT {n}"""


@query("top_n", "G12 W1 W2", _rank_sql("DESC", 10))
def top_n(t: Tables) -> DataFrame:
    wanted = Analysis("top_n", "sum", "l_orderkey", group="l_partkey", value="l_extendedprice", limit=10)
    return rounded(grouped.analyse(t.lineitem, wanted), 2)


@query("bottom_n", "G12 W1 W2", _rank_sql("ASC", 7))
def bottom_n(t: Tables) -> DataFrame:
    wanted = Analysis("top_n", "sum", "l_orderkey", group="l_partkey", value="l_extendedprice", limit=7, descending=False)
    return rounded(grouped.analyse(t.lineitem, wanted), 2)


def _accounting_sql(source: str, value: str) -> str:
    return f"""SELECT (SELECT count(*) FROM cells) AS source_rows, count(*) FILTER (region IS NOT NULL) AS eligible_rows,
      count(*) FILTER (region IS NULL) AS excluded_group_rows,
      (SELECT count(*) FROM cells) - count(*) AS excluded_scope_rows,
      count(*) FILTER (region IS NOT NULL AND customer_id IS NULL) AS missing_entity_rows,
      {value} AS invalid_value_rows, count(DISTINCT region) AS group_count, CAST(0 AS BIGINT) AS groups_without_value
      FROM {source}"""


@query("group_accounting", "G13", f"""{RATIO_CTE}
    SELECT 'ratio' AS analysis, * FROM ({_accounting_sql('scoped', 'CAST(0 AS BIGINT)')})
    UNION ALL SELECT 'sum', * FROM ({_accounting_sql('cells', 'count(*) FILTER (region IS NOT NULL AND number IS NULL)')})""")
def group_accounting(t: Tables) -> DataFrame:
    df = dirty_events(t)
    ratio = grouped.accounting(df, RATIO).withColumn("analysis", F.lit("ratio"))
    return ratio.unionByName(grouped.accounting(df, SUM).withColumn("analysis", F.lit("sum")))


@query("group_checks", "G14 W5", """SELECT * FROM (VALUES ('rows_reconciled', TRUE), ('values_finite', TRUE),
    ('in_order', TRUE), ('within_n', TRUE)) AS v("check", passed)""")
def group_checks(t: Tables) -> DataFrame:
    wanted = Analysis("top_n", "sum", "l_orderkey", group="l_suppkey", value="l_extendedprice", limit=10)
    return grouped.result_checks(t.lineitem, wanted)


@query("ratio_checks", "G14", """SELECT * FROM (VALUES ('rows_reconciled', TRUE), ('values_finite', TRUE),
    ('ratio_bounds', TRUE), ('in_order', TRUE)) AS v("check", passed)""")
def ratio_checks(t: Tables) -> DataFrame:
    return grouped.result_checks(dirty_events(t), RATIO)


@query("rank_share", "W3 W4", """WITH g AS (SELECT p_type AS category, sum(l_extendedprice) AS gmv
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)
    SELECT category, round(gmv, 2) AS gmv, round(gmv / (SELECT sum(gmv) FROM g), 4) AS share,
      row_number() OVER (ORDER BY gmv DESC, category) AS rank FROM g
    ORDER BY rank LIMIT 5""")
def rank_share(t: Tables) -> DataFrame:
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("gmv"))
    found = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("category")).agg(
        F.sum("gmv").alias("gmv"))
    top = grouped.ranked(grouped.with_share(found, "gmv"), "gmv", "category", 5)
    return top.select("category", F.round("gmv", 2).alias("gmv"), F.round("share", 4).alias("share"),
                      F.col("rank").cast("bigint").alias("rank"))


@query("groups_equal_total", "G23", """SELECT 'groups_equal_total' AS "check", TRUE AS passed""")
def groups_equal_total(t: Tables) -> DataFrame:
    wanted = Analysis("group_compare", "sum", "l_orderkey", group="l_returnflag", value="l_extendedprice")
    total = t.lineitem.agg(F.sum("l_extendedprice")).scalar()
    return control_total(grouped.analyse(t.lineitem, wanted), "value", total)
