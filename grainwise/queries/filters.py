"""Every filter operator, on text cells and on native columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.functions.predicates import FilterRule, in_window, matched, matches, matches_category
from grainwise.queries.base import CLEAN_CTE, Tables, dirty_events, query, rounded

OPERAND = ("CASE WHEN regexp_full_match(amount, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
           "THEN TRY_CAST(amount AS DOUBLE) END")


def _text_rule(sign: str, operand: str) -> str:
    return f"""WITH {CLEAN_CTE}, f AS (SELECT event_id, amount, {OPERAND} AS n FROM cells)
    SELECT event_id, amount FROM f
    WHERE coalesce(CASE WHEN n IS NOT NULL THEN n {sign} {operand} ELSE lower(amount) {sign} '{operand}' END, FALSE)"""


def _kept(t: Tables, field: str, operator: str, value: str = "") -> DataFrame:
    df = dirty_events(t)
    return df.filter(matches(df, FilterRule(field, operator, value))).select(
        "event_id", cells.text(df, field).alias(field)
    )


@query("filter_equals", "F1 F9", _text_rule("=", "5"))
def filter_equals(t: Tables) -> DataFrame:
    return _kept(t, "amount", "equals", "5")


@query("filter_not_equals", "F2 N8", f"""WITH {CLEAN_CTE}
    SELECT event_id, region FROM cells WHERE lower(region) <> 'east'""")
def filter_not_equals(t: Tables) -> DataFrame:
    return _kept(t, "region", "not_equals", " EAST ")


@query("filter_greater", "F3 F9", _text_rule(">", "50"))
def filter_greater(t: Tables) -> DataFrame:
    return _kept(t, "amount", "greater", "50")


@query("filter_greater_equal", "F4 F9", _text_rule(">=", "20.5"))
def filter_greater_equal(t: Tables) -> DataFrame:
    return _kept(t, "amount", "greater_equal", "20.5")


@query("filter_less", "F5 F9", _text_rule("<", "10"))
def filter_less(t: Tables) -> DataFrame:
    return _kept(t, "amount", "less", "10")


@query("filter_less_equal", "F6 F9", _text_rule("<=", "2"))
def filter_less_equal(t: Tables) -> DataFrame:
    return _kept(t, "amount", "less_equal", "2")


@query("filter_contains", "F7", f"""WITH {CLEAN_CTE}
    SELECT event_id, customer_id FROM cells WHERE contains(lower(customer_id), 'u-1')""")
def filter_contains(t: Tables) -> DataFrame:
    return _kept(t, "customer_id", "contains", "U-1")


@query("filter_not_empty", "F8", f"""WITH {CLEAN_CTE}
    SELECT event_id, status FROM cells WHERE status IS NOT NULL""")
def filter_not_empty(t: Tables) -> DataFrame:
    return _kept(t, "status", "not_empty")


@query("filter_dated", "F9", f"""WITH {CLEAN_CTE}, f AS (
      SELECT event_id, purchase_date, TRY_CAST(replace(purchase_date, '/', '-') AS TIMESTAMP) AS ts FROM cells)
    SELECT event_id, purchase_date FROM f WHERE coalesce(
      CASE WHEN ts IS NOT NULL THEN ts >= TIMESTAMP '2024-01-15' ELSE lower(purchase_date) >= '2024/1/15' END, FALSE)""")
def filter_dated(t: Tables) -> DataFrame:
    return _kept(t, "purchase_date", "greater_equal", "2024/1/15")


@query("filter_native", "F3 F9", """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice > 450000 AND o_orderdate >= TIMESTAMP '1999-01-01' AND lower(o_orderstatus) = 'f'""")
def filter_native(t: Tables) -> DataFrame:
    df = t.orders
    rules = [FilterRule("o_totalprice", "greater", "450000"), FilterRule("o_orderdate", "greater_equal", "1999-01-01"),
             FilterRule("o_orderstatus", "equals", "f")]
    for rule in rules:
        df = df.filter(matches(df, rule))
    return df.select("o_orderkey", "o_totalprice")


@query("filter_category", "F10", f"""WITH {CLEAN_CTE}
    SELECT event_id, coalesce(lower(status) = 'delivered', FALSE) AS hit,
      coalesce(lower(status) <> 'cancelled', FALSE) AS in_scope, region IS NOT NULL AS placed FROM cells""")
def filter_category(t: Tables) -> DataFrame:
    df = dirty_events(t)
    return df.select(
        "event_id", matches_category(df, FilterRule("status", "equals", "Delivered")).alias("hit"),
        matches_category(df, FilterRule("status", "not_equals", "cancelled")).alias("in_scope"),
        matches_category(df, FilterRule("region", "not_empty")).alias("placed"),
    )


@query("filter_window", "F11 F12", """SELECT o_orderkey, o_orderstatus FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-09-01' AND o_orderstatus = 'F'""")
def filter_window(t: Tables) -> DataFrame:
    return t.orders.filter(in_window(F.col("o_orderdate"), "1997-01-01", "1998-09-01")).filter(
        F.col("o_orderstatus") == "F"
    ).select("o_orderkey", "o_orderstatus")


@query("bound_parameters", "F13", """SELECT event_type, count(*) AS rows FROM events
    WHERE event_type = 'view' OR event_type = 'x'' OR 1=1 --' GROUP BY event_type""")
def bound_parameters(t: Tables) -> DataFrame:
    statement = "SELECT event_type, count(*) AS rows FROM {e} WHERE event_type IN (:a, :b) GROUP BY event_type"
    return t.spark.sql(statement, args={"a": "view", "b": "x' OR 1=1 --"}, e=t.events)


@query("conditional_labels", "F15 F16", f"""WITH {CLEAN_CTE}
    SELECT coalesce(region, status, 'unknown') AS place,
      CASE WHEN day > DATE '2024-01-20' THEN 'late' WHEN day IS NOT NULL THEN 'on_time' ELSE 'undated' END AS delivery,
      count(*) AS rows, round(sum(number), 4) AS amount FROM cells GROUP BY ALL""")
def conditional_labels(t: Tables) -> DataFrame:
    df = dirty_events(t)
    d = cells.day(df, "purchase_date")
    label = F.when(d > F.lit("2024-01-20").cast("date"), F.lit("late")).when(d.isNotNull(), F.lit("on_time")).otherwise(
        F.lit("undated"))
    place = F.coalesce(cells.text(df, "region"), cells.text(df, "status"), F.lit("unknown"))
    found = df.groupBy(place.alias("place"), label.alias("delivery")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(cells.number(df, "amount")).alias("amount"))
    return rounded(found)


@query("filter_flags", "F1 F3 F7", f"""WITH {CLEAN_CTE}, f AS (SELECT *, {OPERAND} AS n FROM cells)
    SELECT count(*) FILTER (coalesce(CASE WHEN n IS NOT NULL THEN n > 30 ELSE lower(amount) > '30' END, FALSE)) AS large,
      count(*) FILTER (NOT coalesce(CASE WHEN n IS NOT NULL THEN n > 30 ELSE lower(amount) > '30' END, FALSE)) AS other,
      count(*) FILTER (NOT coalesce(lower(region) <> 'south', FALSE)) AS not_elsewhere FROM f""")
def filter_flags(t: Tables) -> DataFrame:
    df = dirty_events(t)
    large, elsewhere = (matched(df, r) for r in (
        FilterRule("amount", "greater", "30"), FilterRule("region", "not_equals", "south")))
    return df.agg(F.count_if(large).alias("large"), F.count_if(~large).alias("other"),
                  F.count_if(~elsewhere).alias("not_elsewhere"))
