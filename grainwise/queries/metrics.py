"""Scalar metrics with accounting, checks and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions.predicates import FilterRule
from grainwise.operators import metrics
from grainwise.operators.audit import union_all
from grainwise.operators.metrics import Binding, Metric
from grainwise.operators.profile import fingerprint
from grainwise.queries.base import CLEAN_CTE, Tables, dirty_events, query, rounded

SCOPE = FilterRule("region", "not_equals", "south")
HIT = FilterRule("status", "equals", "delivered")


def _metric(kind: str) -> Metric:
    return Metric(kind, "customer_id", "amount" if kind in ("amount", "average") else None, SCOPE,
                  HIT if kind == "ratio" else None)


BASE = f"""WITH {CLEAN_CTE},
    base AS (SELECT *, coalesce(lower(status) = 'delivered', FALSE) AS hit FROM cells WHERE lower(region) <> 'south')"""
VALUE_SQL = {
    "count": "CAST(count(DISTINCT customer_id) AS DOUBLE)",
    "amount": "round(sum(number), 4)",
    "average": "round(sum(number) / count(DISTINCT CASE WHEN number IS NOT NULL THEN customer_id END), 4)",
    "ratio": "round(count(DISTINCT CASE WHEN hit THEN customer_id END) / count(DISTINCT customer_id), 4)",
}


def _sql(kind: str) -> str:
    invalid = "count(*) FILTER (number IS NULL)" if kind in ("amount", "average") else "CAST(0 AS BIGINT)"
    hits = "count(DISTINCT CASE WHEN hit THEN customer_id END)" if kind == "ratio" else "CAST(NULL AS BIGINT)"
    base = "count(DISTINCT customer_id)" if kind == "ratio" else "CAST(NULL AS BIGINT)"
    return f"""{BASE} SELECT {VALUE_SQL[kind]} AS value, (SELECT count(*) FROM cells) AS source_rows,
      count(*) AS eligible_rows, count(DISTINCT customer_id) AS distinct_entities,
      count(*) FILTER (customer_id IS NULL) AS missing_entity_rows, {invalid} AS invalid_value_rows,
      {hits} AS numerator, {base} AS denominator FROM base"""


@query("metric_count", "A1 A5", _sql("count"))
def metric_count(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate(dirty_events(t), _metric("count")))


@query("metric_amount", "A2 A5", _sql("amount"))
def metric_amount(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate(dirty_events(t), _metric("amount")))


@query("metric_average", "A3 A5 X1", _sql("average"))
def metric_average(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate(dirty_events(t), _metric("average")))


@query("metric_ratio", "A4 A5", _sql("ratio"))
def metric_ratio(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate(dirty_events(t), _metric("ratio")))


@query("metric_no_value", "A2 N9", """
    SELECT CAST(NULL AS DOUBLE) AS value, (SELECT count(*) FROM events) AS source_rows,
      (SELECT count(*) FROM events) AS eligible_rows, (SELECT count(DISTINCT user_id) FROM events) AS distinct_entities,
      CAST(0 AS BIGINT) AS missing_entity_rows, (SELECT count(*) FROM events) AS invalid_value_rows,
      CAST(NULL AS BIGINT) AS numerator, CAST(NULL AS BIGINT) AS denominator""")
def metric_no_value(t: Tables) -> DataFrame:
    """A sum over texts that are no numbers is absent, not zero."""
    return metrics.evaluate(t.events, Metric("amount", "user_id", "event_type"))


@query("metric_native", "A1 A2 A3 A4", """
    SELECT 'count' AS metric, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS value FROM lineitem
    UNION ALL SELECT 'amount', round(sum(l_extendedprice), 2) FROM lineitem
    UNION ALL SELECT 'average', round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 2) FROM lineitem
    UNION ALL SELECT 'ratio', round(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)
      / count(DISTINCT l_orderkey), 2) FROM lineitem""")
def metric_native(t: Tables) -> DataFrame:
    rows = []
    for kind in metrics.KINDS:
        m = Metric(kind, "l_orderkey", "l_extendedprice", numerator=FilterRule("l_returnflag", "equals", "R"))
        rows.append(metrics.evaluate(t.lineitem, m).select(F.lit(kind).alias("metric"), "value"))
    return rounded(union_all(rows), 2)


@query("metric_checks", "A6", f"""{BASE}, v AS (SELECT {VALUE_SQL['ratio']} AS r, count(DISTINCT customer_id) AS e FROM base)
    SELECT 'scope_unchanged' AS "check", FALSE AS passed UNION ALL SELECT 'entity_present', e > 0 FROM v
    UNION ALL SELECT 'value_finite', r IS NOT NULL FROM v UNION ALL SELECT 'ratio_bounds', r BETWEEN 0 AND 1 FROM v""")
def metric_checks(t: Tables) -> DataFrame:
    """Bound to a row count the table never had, so the scope check must fail."""
    result = metrics.evaluate(dirty_events(t), _metric("ratio"))
    return metrics.result_checks(result, _metric("ratio"), bound_rows=-1)


@query("metric_drift", "A7", """
    SELECT 'row_count_unchanged' AS "check", count(*) = 15000 AS passed FROM orders
    UNION ALL SELECT 'fields_present', FALSE
    UNION ALL SELECT 'content_unchanged', FALSE""")
def metric_drift(t: Tables) -> DataFrame:
    binding = Binding(15000, ("o_orderkey", "o_discount"), fingerprint="of another version")
    return metrics.drift_checks(t.orders, binding, fingerprint(t.orders, "orders"))


@query("metric_display", "A9", f"""{BASE}, v AS (SELECT {VALUE_SQL['ratio']} AS r, sum(number) AS a FROM base)
    SELECT 'ratio' AS metric, printf('%.2f', (SELECT count(DISTINCT CASE WHEN hit THEN customer_id END)
      / count(DISTINCT customer_id) FROM base) * 100) || '%' AS shown
    UNION ALL SELECT 'none', 'not computable'
    UNION ALL SELECT 'count', format('{{:,}}', count(DISTINCT customer_id)) FROM base""")
def metric_display(t: Tables) -> DataFrame:
    df = dirty_events(t)
    ratio = metrics.evaluate(df, _metric("ratio")).select(
        F.lit("ratio").alias("metric"), metrics.display(F.col("value"), "ratio").alias("shown"))
    none = metrics.evaluate(t.events, Metric("amount", "user_id", "event_type")).select(
        F.lit("none").alias("metric"), metrics.display(F.col("value"), "amount").alias("shown"))
    count = metrics.evaluate(df, _metric("count")).select(
        F.lit("count").alias("metric"), metrics.display(F.col("value"), "count").alias("shown"))
    return union_all([ratio, none, count])
