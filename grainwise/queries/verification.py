"""Both computations of a result, compared; parity of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions.predicates import FilterRule
from grainwise.operators import grouped, verify
from grainwise.operators.audit import union_all
from grainwise.operators.grouped import Analysis
from grainwise.operators.metrics import KINDS, Metric
from grainwise.queries.base import CLEAN_CTE, Tables, dirty_events, query, rounded
from grainwise.queries.metrics import BASE, VALUE_SQL, _metric


@query("verify_metric", "V1 V3 S11", f"""{BASE} SELECT 'count' AS metric, {VALUE_SQL['count']} AS value, TRUE AS passed FROM base
    UNION ALL SELECT 'amount', {VALUE_SQL['amount']}, TRUE FROM base
    UNION ALL SELECT 'average', {VALUE_SQL['average']}, TRUE FROM base
    UNION ALL SELECT 'ratio', {VALUE_SQL['ratio']}, TRUE FROM base""")
def verify_metric(t: Tables) -> DataFrame:
    """The second path's value, and whether all eight measures of both paths agree."""
    df, parts = dirty_events(t), []
    for kind in KINDS:
        compared = verify.verify_metric(df, _metric(kind))
        value = F.max(F.when(F.col("measure") == "value", F.col("reference")))
        parts.append(compared.agg(F.lit(kind).alias("metric"), value.alias("value"), F.min("passed").alias("passed")))
    return rounded(union_all(parts))


ANALYSES = {
    "count": Analysis("group_compare", "count_distinct", "customer_id", group="region"),
    "sum by week": Analysis("trend", "sum", "customer_id", time="purchase_date", grain="week", value="amount"),
    "average by quarter": Analysis("trend", "average", "customer_id", time="purchase_date", grain="quarter", value="amount"),
    "ratio": Analysis("group_compare", "ratio", "customer_id", group="region",
                      numerator=FilterRule("status", "equals", "delivered"),
                      denominator=FilterRule("status", "not_equals", "cancelled")),
}
CHECKS = ["groups_agree", "values_agree", "rows_agree", "entities_agree", "exclusions_agree", "ratio_parts_agree"]


@query("verify_group", "V2 V3", f"""WITH {CLEAN_CTE},
    n AS (SELECT 'count' AS analysis, count(*) AS compared FROM (SELECT DISTINCT region FROM cells)
      UNION ALL SELECT 'sum by week', count(*) FROM (SELECT DISTINCT strftime(day, '%G-W%V') FROM cells)
      UNION ALL SELECT 'average by quarter', count(*) FROM (SELECT DISTINCT quarter(day), year(day) FROM cells)
      UNION ALL SELECT 'ratio', count(*) FROM (SELECT DISTINCT region, coalesce(lower(status) <> 'cancelled', FALSE) FROM cells))
    SELECT analysis, unnest({CHECKS}) AS "check", compared, CAST(0 AS BIGINT) AS mismatches, TRUE AS passed FROM n""")
def verify_group(t: Tables) -> DataFrame:
    return union_all([
        verify.verify_groups(dirty_events(t), a).withColumn("analysis", F.lit(name)) for name, a in ANALYSES.items()
    ])


@query("verify_catches_error", "V2 V4", """SELECT CAST(6 AS BIGINT) AS checks, CAST(1 AS BIGINT) AS failed, FALSE AS passed""")
def verify_catches_error(t: Tables) -> DataFrame:
    """One wrong value among all groups must fail the verdict."""
    wanted = Analysis("group_compare", "sum", "l_orderkey", group="l_suppkey", value="l_extendedprice")
    primary = grouped.per_group(t.lineitem, wanted)
    wrong = primary.withColumn("value", F.when(F.col("key") == "7", F.col("value") + 1).otherwise(F.col("value")))
    return verify.verdict(verify.verify_groups(t.lineitem, wanted, wrong))


@query("verify_released", "V5", """SELECT l_returnflag AS key, round(sum(l_extendedprice), 2) AS value, count(*) AS source_rows,
    count(DISTINCT l_orderkey) AS distinct_entities, CAST(0 AS BIGINT) AS invalid_value_rows FROM lineitem GROUP BY 1""")
def verify_released(t: Tables) -> DataFrame:
    wanted = Analysis("group_compare", "sum", "l_orderkey", group="l_returnflag", value="l_extendedprice")
    groups = grouped.per_group(t.lineitem, wanted)
    released = verify.release(grouped.analyse(t.lineitem, wanted, groups), verify.verify_groups(t.lineitem, wanted, groups))
    return rounded(released, 2)


@query("verify_typed_metric", "V1", """SELECT 'value' AS measure,
      round(sum(o_totalprice) / count(DISTINCT o_custkey), 2) AS reference, TRUE AS passed FROM orders
      WHERE o_orderdate >= TIMESTAMP '1998-03-01'
    UNION ALL SELECT 'eligible_rows', count(*), TRUE FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01'""")
def verify_typed_metric(t: Tables) -> DataFrame:
    metric = Metric("average", "o_custkey", "o_totalprice", FilterRule("o_orderdate", "greater_equal", "1998/3/1"))
    compared = verify.verify_metric(t.orders, metric).filter("measure IN ('value', 'eligible_rows')")
    return rounded(compared.select("measure", "reference", "passed"), 2)


@query("text_table", "S11", f"""WITH {CLEAN_CTE}
    SELECT CAST(event_id AS VARCHAR) AS event_id, customer_id, purchase_date, amount, region, status FROM cells""")
def text_table(t: Tables) -> DataFrame:
    return verify.text_table(dirty_events(t))


@query("table_parity", "V6 W8", """SELECT 'nation' AS dataset, count(*) AS bound_rows, count(*) AS current_rows,
      'unchanged' AS status FROM nation
    UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_orderstatus <> 'P'), 'changed' FROM orders
    UNION ALL SELECT 'supplier', count(*), count(*), 'unchanged' FROM supplier""")
def table_parity(t: Tables) -> DataFrame:
    source = {"nation": t.nation, "orders": t.orders, "supplier": t.supplier}
    copy = {"nation": t.nation, "orders": t.orders.filter("o_orderstatus <> 'P'"), "supplier": t.supplier.orderBy("s_name")}
    return verify.table_parity(source, copy)
