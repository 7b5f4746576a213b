"""Retail KPIs over orders, items, customers, products and reviews.

Grain safety is written into the plan: items and reviews are folded to one row
per order *before* they meet the orders, so no amount can fan out. That fold
combines on the map side, and what is joined afterwards is one row per order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.functions.predicates import in_window
from grainwise.operators import keys
from grainwise.operators.grouped import ranked, with_share
from grainwise.operators.metrics import check_rows
from grainwise.sources.csv import manifest

# Fixed values.
DELIVERED = "delivered"
NEGATIVE_SCORE = 2
UNKNOWN = "unknown"
LATE, ON_TIME = "late", "on_time"
TOP_CATEGORIES = 5
CENT = 0.01


@dataclass(frozen=True)
class Retail:
    """The source tables under their business names.

    orders: order_id, customer_id, status, purchased_at, delivered_at, promised_at
    items: order_id, item_no, product_id, price, freight
    customers: customer_id, buyer_id
    products: product_id, category_code (may be absent or NULL)
    categories: category_code, category (translation)
    reviews: order_id, score
    """

    orders: DataFrame
    items: DataFrame
    customers: DataFrame
    products: DataFrame
    categories: DataFrame
    reviews: DataFrame
    start: str
    end: str

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("orders", "items", "customers", "products", "categories", "reviews")}


def scoped_orders(r: Retail) -> DataFrame:
    """Orders bought in [start, end), all statuses; the window reaches the scan."""
    return r.orders.filter(in_window(F.col("purchased_at"), r.start, r.end)).withColumn(
        "month", F.date_format("purchased_at", "yyyy-MM")
    )


def order_amounts(r: Retail) -> DataFrame:
    return r.items.groupBy("order_id").agg(F.sum("price").alias("gmv"), F.sum("freight").alias("freight"))


def _delivered(r: Retail) -> DataFrame:
    return scoped_orders(r).filter(F.col("status") == DELIVERED)


def delivered_amounts(r: Retail) -> DataFrame:
    """Delivered orders with their item totals; has_items marks those with any."""
    amounts = order_amounts(r).withColumn("has_items", F.lit(True))
    return _delivered(r).join(amounts, "order_id", "left").withColumn("has_items", F.coalesce("has_items", F.lit(False)))


def delivered_orders(r: Retail, strict: bool = False) -> DataFrame:
    """Delivered orders with their item totals and buyer, one row per order.

    ``strict`` fails the job when orders or customers repeat their key; the same
    facts are otherwise reported by ``validations``.
    """
    orders, customers = delivered_amounts(r), r.customers
    if strict:
        orders, customers = keys.assert_unique(orders, ["order_id"]), keys.assert_unique(customers, ["customer_id"])
    return orders.join(customers, "customer_id", "left")


def days_between(later: Column, earlier: Column) -> Column:
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return seconds / F.lit(86_400_000_000.0)


def kpis(r: Retail) -> DataFrame:
    """One row: orders, delivery, buyers, value, average order, delivery days.

    Three passes that read only what they need: order ids for the total,
    customers for the buyers, items for the value.
    """
    total = scoped_orders(r).select("order_id").distinct().agg(F.count("order_id")).scalar()
    customers = _delivered(r).select("customer_id").distinct()
    buyers = customers.join(r.customers, "customer_id").select("buyer_id").distinct().agg(F.count("buyer_id")).scalar()
    per_order = delivered_amounts(r).groupBy("order_id").agg(
        F.sum("gmv").alias("gmv"),
        F.sum(days_between(F.col("delivered_at"), F.col("purchased_at"))).alias("days"),
        F.count("delivered_at").alias("dated"),
    )
    facts = per_order.agg(
        F.count(F.lit(1)).alias("delivered_orders"), F.coalesce(F.sum("gmv"), F.lit(0.0)).alias("gmv"),
        cells.safe_divide(F.sum("days"), F.sum("dated")).alias("delivery_days"),
    )
    return facts.select(
        total.alias("total_orders"),
        "delivered_orders",
        F.round(cells.safe_divide(F.col("delivered_orders"), total), 6).alias("delivered_rate"),
        buyers.alias("delivered_buyers"),
        F.round("gmv", 2).alias("product_gmv"),
        F.round(cells.safe_divide(F.col("gmv"), F.col("delivered_orders")), 2).alias("average_order_value"),
        F.round("delivery_days", 2).alias("average_delivery_days"),
    )


def monthly(r: Retail) -> DataFrame:
    """Months with deliveries: all orders, delivered orders, value.

    Both sides are folded to one row per month before they are joined.
    """
    def count_orders(df: DataFrame, name: str, *more: Column) -> DataFrame:
        return df.groupBy("month", "order_id").agg(F.sum("gmv").alias("gmv")).groupBy("month").agg(
            F.count(F.lit(1)).alias(name), *more
        )

    everything = count_orders(scoped_orders(r).withColumn("gmv", F.lit(0.0)), "all_orders")
    done = count_orders(
        delivered_amounts(r), "delivered_orders", F.coalesce(F.sum("gmv"), F.lit(0.0)).alias("gmv"),
    )
    return done.join(everything, "month", "left").select(
        "month", "all_orders", "delivered_orders", F.round("gmv", 2).alias("product_gmv"),
        F.round(F.col("gmv") / 1000, 2).alias("product_gmv_thousands"),
    ).orderBy("month")


def categories(r: Retail) -> DataFrame:
    """Per category: value, distinct delivered orders, items, share of the total.

    Items are folded to (order, product) before the category lookup, which keeps
    a best-selling product from dominating the join.
    """
    delivered = _delivered(r).select("order_id")
    lines = (
        r.items.join(delivered, "order_id", "left_semi")
        .groupBy("order_id", "product_id")
        .agg(F.sum("price").alias("gmv"), F.count("item_no").alias("items"))
    )
    named = (
        lines.join(r.products.select("product_id", "category_code"), "product_id", "left")
        .join(r.categories, "category_code", "left")
        .withColumn("category", F.coalesce("category", "category_code", F.lit(UNKNOWN)))
    )
    per_order = named.groupBy("category", "order_id").agg(F.sum("gmv").alias("gmv"), F.sum("items").alias("items"))
    found = per_order.groupBy("category").agg(
        F.sum("gmv").alias("gmv"), F.count(F.lit(1)).alias("delivered_orders"), F.sum("items").alias("item_count")
    )
    return with_share(found, "gmv", "gmv_share")


def top_categories(r: Retail, n: int = TOP_CATEGORIES) -> DataFrame:
    return ranked(categories(r), "gmv", "category", n).select(
        F.col("rank").cast("bigint").alias("rank"), "category", F.round("gmv", 2).alias("product_gmv"),
        F.round("gmv_share", 6).alias("gmv_share"), "delivered_orders", "item_count",
    )


def top_share(r: Retail, n: int = TOP_CATEGORIES) -> DataFrame:
    """Combined share of the n largest categories."""
    head = categories(r).orderBy(F.col("gmv").desc(), F.col("category").asc()).limit(n)
    return head.agg(F.count(F.lit(1)).alias("categories"), F.round(F.sum("gmv_share"), 6).alias("combined_share"))


def review_flags(r: Retail) -> DataFrame:
    """One row per reviewed order: negative if any of its reviews is."""
    return r.reviews.groupBy("order_id").agg(
        F.max(F.col("score") <= NEGATIVE_SCORE).alias("negative"), F.count("score").alias("reviews")
    )


def reviewed_deliveries(r: Retail) -> DataFrame:
    orders = _delivered(r).filter(F.col("delivered_at").isNotNull() & F.col("promised_at").isNotNull())
    return orders.join(review_flags(r), "order_id").withColumn(
        "delivery", F.when(F.col("delivered_at") > F.col("promised_at"), F.lit(LATE)).otherwise(F.lit(ON_TIME))
    )


def delivery_reviews(r: Retail) -> DataFrame:
    """Negative-review rate of late and on-time deliveries."""
    return reviewed_deliveries(r).groupBy("delivery", "order_id").agg(F.max("negative").alias("negative")).groupBy(
        "delivery"
    ).agg(
        F.count(F.lit(1)).alias("reviewed_orders"), F.count_if("negative").alias("negative_orders"),
    ).withColumn("negative_rate", F.round(cells.safe_divide(F.col("negative_orders"), F.col("reviewed_orders")), 6))


def delivery_risk(r: Retail) -> DataFrame:
    """Gap and ratio of the two rates, one row; an association, not a cause."""
    rate = F.col("negative_rate")
    both = delivery_reviews(r).agg(
        F.max(F.when(F.col("delivery") == LATE, rate)).alias("late_rate"),
        F.max(F.when(F.col("delivery") == ON_TIME, rate)).alias("on_time_rate"),
    )
    return both.select(
        "late_rate", "on_time_rate", F.round(F.col("late_rate") - F.col("on_time_rate"), 6).alias("rate_gap"),
        F.round(cells.safe_divide(F.col("late_rate"), F.col("on_time_rate")), 4).alias("risk_ratio"),
    )


def peak_month(r: Retail) -> DataFrame:
    """The month with the largest value; the earlier one on a tie."""
    return monthly(r).orderBy(F.col("product_gmv").desc(), F.col("month").asc()).limit(1).select(
        "month", "product_gmv"
    )


def overview_and_trend(r: Retail) -> DataFrame:
    """Both answers in one frame: (section, month, measure, value)."""
    names = ["total_orders", "delivered_orders", "delivered_rate", "delivered_buyers", "product_gmv",
             "average_order_value", "average_delivery_days"]

    def long(df: DataFrame, section: str, month: Column, columns: list[str]) -> DataFrame:
        cells_ = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]
        return df.select(F.lit(section).alias("section"), month.alias("month"), F.inline(F.array(*cells_)))

    return long(kpis(r), "overview", F.lit(None).cast("string"), names).unionByName(
        long(monthly(r), "trend", F.col("month"), ["all_orders", "delivered_orders", "product_gmv"])
    )


def validations(r: Retail) -> DataFrame:
    """The eight source checks of the job: (check, found, passed)."""
    def row(check: str, df: DataFrame, found: Column, passed: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), found.cast("double").alias("found"), passed.alias("passed"))

    zero = F.col("n") == 0
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")

    def repeats(df: DataFrame, *key: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(surplus)

    delivered = delivered_amounts(r)
    unmatched = delivered.agg(F.count_if(~F.col("has_items")).alias("n"))
    undated = r.orders.agg(F.count_if(F.col("purchased_at").isNull()).alias("n"))
    total = delivered.agg(F.coalesce(F.sum("gmv"), F.lit(0.0))).scalar()
    months = monthly(r).agg(F.coalesce(F.sum("product_gmv"), F.lit(0.0)).alias("n"))
    groups = categories(r).agg(F.coalesce(F.sum("gmv"), F.lit(0.0)).alias("n"))
    reviewed = repeats(reviewed_deliveries(r), "order_id")
    rates = delivery_reviews(r).agg(F.count_if(~F.col("negative_rate").between(0, 1)).alias("n"))
    n = F.col("n")
    parts = [
        row("orders_primary_key", repeats(r.orders, "order_id"), n, zero),
        row("items_composite_key", repeats(r.items, "order_id", "item_no"), n, zero),
        row("delivered_items_matched", unmatched, n, zero),
        row("purchase_time_present", undated, n, zero),
        row("monthly_total_reconciles", months, F.round(n, 2), F.abs(n - F.round(total, 2)) < CENT),
        row("category_total_reconciles", groups, F.round(n, 2), F.abs(n - total) < CENT),
        row("reviews_at_order_grain", reviewed, n, zero),
        row("negative_rate_in_range", rates, n, zero),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def control_total(groups: DataFrame, value: str, total: Column) -> DataFrame:
    """Do the groups add up to the total, to the cent?"""
    return check_rows(
        groups.agg(F.sum(value).alias("s")), [("groups_equal_total", F.abs(F.col("s") - total) < CENT)]
    )


def snapshot(r: Retail) -> DataFrame:
    """The whole report as one nested row.

    Every list in it is short by construction: calendar months, five
    categories, two delivery states, eight checks, six sources.
    """
    def listed(df: DataFrame) -> Column:
        # one task, but over a report section only
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns)))).scalar()

    scope = F.struct(F.lit(r.start).alias("start"), F.lit(r.end).alias("end_exclusive"))
    figures = kpis(r)
    return figures.select(
        scope.alias("scope"), F.struct(*figures.columns).alias("kpis"), listed(monthly(r)).alias("monthly"),
        listed(top_categories(r)).alias("top_categories"), listed(delivery_reviews(r)).alias("delivery"),
        listed(validations(r)).alias("validation"), listed(manifest(r.tables())).alias("sources"),
    )


@dataclass(frozen=True)
class Definition:
    label: str
    formula: str
    population: str
    unit: str
    caveat: str = ""


# The metrics this job answers for; anything else is not available.
DEFINITIONS = {
    "total_orders": Definition("Total orders", "count distinct order_id", "all statuses in the window", "orders"),
    "delivered_orders": Definition("Delivered orders", "count distinct order_id", "status = delivered", "orders"),
    "delivered_rate": Definition("Delivered rate", "delivered_orders / total_orders", "orders in the window", "percent"),
    "delivered_buyers": Definition("Delivered buyers", "count distinct buyer_id", "delivered orders", "people"),
    "product_gmv": Definition("Product value", "sum(price)", "items of delivered orders", "currency",
                              "without freight; neither revenue nor profit"),
    "average_order_value": Definition("Average order value", "product_gmv / delivered_orders", "delivered orders",
                                      "currency per order"),
    "average_delivery_days": Definition("Delivery days", "avg(delivered_at - purchased_at)",
                                        "delivered orders with a delivery time", "days"),
    "category_product_gmv": Definition("Category value", "sum(price) by category", "items of delivered orders",
                                       "currency", "order counts of categories do not add up"),
    "negative_review_rate": Definition("Negative review rate", "negative orders / reviewed orders",
                                       "delivered orders with both dates and a review", "percent"),
    "late_delivery": Definition("Late delivery", "delivered_at > promised_at", "delivered orders", "flag"),
}


def definition(metric: str) -> Definition:
    if metric not in DEFINITIONS:
        raise KeyError(f"{metric} is not defined; defined are {', '.join(DEFINITIONS)}")
    return DEFINITIONS[metric]

