"""The retail KPI job over the driver tables.

Substitutions: a finished order ('F') counts as delivered; its delivery is the
latest line shipment, promised 1200 days after the order; a returned line ('R')
is a review with score 1, any other line one with score 5; freight is the line's
tax share of its price; the category translation lower-cases the part type and
knows all types but one, whose products fall back to their code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.plans import retail
from grainwise.plans.retail import Retail
from grainwise.queries.base import Tables, query, rounded

START, END = "1997-01-01", "1998-09-01"
UNTRANSLATED = "PROMO"


def source(t: Tables) -> Retail:
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("delivered_at"))
    orders = t.orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("delivered")).otherwise(F.lit("open")).alias("status"),
        F.col("o_orderdate").alias("purchased_at"), "delivered_at",
        (F.col("o_orderdate") + F.expr("INTERVAL 1200 DAYS")).alias("promised_at"),
    )
    items = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("item_no"),
        F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight"),
    )
    customers = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("buyer_id"))
    products = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category_code"))
    categories = t.part.filter(F.col("p_type") != UNTRANSLATED).groupBy(F.col("p_type").alias("category_code")).agg(
        F.lower(F.min("p_type")).alias("category"))
    reviews = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(5)).alias("score"),
    )
    return Retail(orders, items, customers, products, categories, reviews, START, END)


CTE = f"""shipped AS (SELECT l_orderkey, max(l_shipdate) AS delivered_at FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus = 'F' AS delivered,
      o_orderdate AS purchased_at, delivered_at, o_orderdate + INTERVAL 1200 DAY AS promised_at,
      strftime(o_orderdate, '%Y-%m') AS month
      FROM orders LEFT JOIN shipped ON o_orderkey = l_orderkey
      WHERE o_orderdate >= TIMESTAMP '{START}' AND o_orderdate < TIMESTAMP '{END}'),
    i AS (SELECT l_orderkey AS order_id, sum(l_extendedprice) AS gmv FROM lineitem GROUP BY 1),
    d AS (SELECT o.*, i.gmv, i.order_id IS NOT NULL AS has_items, c_name AS buyer_id FROM o LEFT JOIN i USING (order_id)
      LEFT JOIN customer ON customer_id = c_custkey WHERE delivered),
    k AS (SELECT (SELECT count(DISTINCT order_id) FROM o) AS total_orders, count(DISTINCT order_id) AS delivered_orders,
      round(count(DISTINCT order_id) / (SELECT count(DISTINCT order_id) FROM o), 6) AS delivered_rate,
      count(DISTINCT buyer_id) AS delivered_buyers, round(sum(gmv), 2) AS product_gmv,
      round(sum(gmv) / count(DISTINCT order_id), 2) AS average_order_value,
      round(avg(epoch(delivered_at - purchased_at) / 86400), 2) AS average_delivery_days FROM d),
    m AS (SELECT month, (SELECT count(DISTINCT order_id) FROM o WHERE o.month = d.month) AS all_orders,
      count(DISTINCT order_id) AS delivered_orders, round(sum(gmv), 2) AS product_gmv,
      round(sum(gmv) / 1000, 2) AS product_gmv_thousands FROM d GROUP BY month),
    lines AS (SELECT CASE WHEN p_type <> '{UNTRANSLATED}' THEN lower(p_type) ELSE coalesce(p_type, 'unknown') END AS category,
      l_orderkey, l_extendedprice FROM lineitem JOIN d ON l_orderkey = order_id LEFT JOIN part ON l_partkey = p_partkey),
    c AS (SELECT category, sum(l_extendedprice) AS gmv, count(DISTINCT l_orderkey) AS delivered_orders,
      count(*) AS item_count, sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lines) AS gmv_share
      FROM lines GROUP BY category),
    r AS (SELECT l_orderkey AS order_id, bool_or(l_returnflag = 'R') AS negative FROM lineitem GROUP BY 1),
    v AS (SELECT d.order_id, negative, CASE WHEN delivered_at > promised_at THEN 'late' ELSE 'on_time' END AS delivery
      FROM d JOIN r USING (order_id) WHERE delivered_at IS NOT NULL),
    w AS (SELECT delivery, count(DISTINCT order_id) AS reviewed_orders, count(*) FILTER (negative) AS negative_orders,
      round(count(*) FILTER (negative) / count(DISTINCT order_id), 6) AS negative_rate FROM v GROUP BY delivery)"""


@query("retail_kpis", "A10", f"WITH {CTE} SELECT * FROM k")
def kpis(t: Tables) -> DataFrame:
    return retail.kpis(source(t))


@query("retail_monthly", "G18", f"WITH {CTE} SELECT * FROM m")
def monthly(t: Tables) -> DataFrame:
    return retail.monthly(source(t))


@query("retail_category_rank", "G19", f"""WITH {CTE} SELECT row_number() OVER (ORDER BY gmv DESC, category) AS rank, category,
    round(gmv, 2) AS product_gmv, round(gmv_share, 6) AS gmv_share, delivered_orders, item_count FROM c
    ORDER BY rank LIMIT 5""")
def category_rank(t: Tables) -> DataFrame:
    return retail.top_categories(source(t))


@query("retail_delivery_review", "G20", f"WITH {CTE} SELECT * FROM w")
def delivery_review(t: Tables) -> DataFrame:
    return retail.delivery_reviews(source(t))


@query("retail_delivery_risk", "G20", f"""WITH {CTE}, x AS (SELECT max(negative_rate) FILTER (delivery = 'late') AS l,
      max(negative_rate) FILTER (delivery = 'on_time') AS o FROM w)
    SELECT l AS late_rate, o AS on_time_rate, round(l - o, 6) AS rate_gap, round(l / o, 4) AS risk_ratio FROM x""")
def delivery_risk(t: Tables) -> DataFrame:
    return retail.delivery_risk(source(t))


@query("retail_peak_month", "G21", f"""WITH {CTE} SELECT month, product_gmv FROM m ORDER BY product_gmv DESC, month LIMIT 1""")
def peak_month(t: Tables) -> DataFrame:
    return retail.peak_month(source(t))


@query("retail_top_share", "G22", f"""WITH {CTE} SELECT count(*) AS categories, round(sum(gmv_share), 6) AS combined_share
    FROM (SELECT * FROM c ORDER BY gmv DESC, category LIMIT 5)""")
def top_share(t: Tables) -> DataFrame:
    return retail.top_share(source(t))


@query("retail_overview_trend", "G24", f"""WITH {CTE}
    SELECT 'overview' AS section, CAST(NULL AS VARCHAR) AS month, unnest(['total_orders', 'delivered_orders', 'delivered_rate',
      'delivered_buyers', 'product_gmv', 'average_order_value', 'average_delivery_days']) AS measure,
      unnest([total_orders::DOUBLE, delivered_orders, delivered_rate, delivered_buyers, product_gmv, average_order_value,
      average_delivery_days]) AS value FROM k
    UNION ALL SELECT 'trend', month, unnest(['all_orders', 'delivered_orders', 'product_gmv']),
      unnest([all_orders::DOUBLE, delivered_orders, product_gmv]) FROM m""")
def overview_trend(t: Tables) -> DataFrame:
    return retail.overview_and_trend(source(t))


def _repeats(table: str, key: str) -> str:
    return f"(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {table} GROUP BY {key}))::DOUBLE"


@query("retail_validations", "Q14 G23", f"""WITH {CTE}, f AS (SELECT {_repeats('orders', 'o_orderkey')} AS a,
      {_repeats('lineitem', 'l_orderkey, l_linenumber')} AS b,
      (SELECT count(*) FROM d WHERE NOT has_items)::DOUBLE AS u, (SELECT count(*) FROM orders WHERE o_orderdate IS NULL)::DOUBLE
      AS n, (SELECT round(sum(product_gmv), 2) FROM m) AS s, (SELECT round(sum(gmv), 2) FROM c) AS g)
    SELECT 'orders_primary_key' AS "check", a AS found, a = 0 AS passed FROM f
    UNION ALL SELECT 'items_composite_key', b, b = 0 FROM f UNION ALL SELECT 'delivered_items_matched', u, u = 0 FROM f
    UNION ALL SELECT 'purchase_time_present', n, n = 0 FROM f UNION ALL SELECT 'monthly_total_reconciles', s, TRUE FROM f
    UNION ALL SELECT 'category_total_reconciles', g, TRUE FROM f
    UNION ALL SELECT 'reviews_at_order_grain', 0.0::DOUBLE, TRUE UNION ALL SELECT 'negative_rate_in_range', 0.0::DOUBLE, TRUE""")
def validations(t: Tables) -> DataFrame:
    return retail.validations(source(t))


@query("retail_snapshot", "S12")
def snapshot(t: Tables) -> DataFrame:
    return retail.snapshot(source(t)).select(F.to_json(F.struct("*")).alias("report"))


@query("retail_order_amounts", "J24", f"""WITH {CTE} SELECT order_id, round(gmv, 2) AS gmv, buyer_id, has_items FROM d""")
def order_amounts(t: Tables) -> DataFrame:
    return rounded(retail.delivered_orders(source(t), strict=True).select("order_id", "gmv", "buyer_id", "has_items"), 2)
