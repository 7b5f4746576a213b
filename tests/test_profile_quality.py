import pytest
from pyspark.sql import functions as F

from frames import text_frame
from grainwise.functions import cells
from grainwise.operators import cleaning, impact, order_stats, profile, quality
from grainwise.operators.cleaning import Repair
from grainwise.operators.grouped import Analysis
from grainwise.operators.impact import MetricContext

NAMES = ["order_id", "customer_id", "purchase_date", "amount", "region"]
ROWS = [
    ["R-20", "K-1", "2025-04-01", "12", "Nord"], ["R-21", "", "2025-04-02", "14", "Sued"], ["R-22", "K-3", "2025-04-03", "13", "Nord"],
    ["R-23", "K-4", "2025-04-04", "15", ""], ["R-24", "K-5", "2025-04-05", "800", "Nord"], ["R-25", "K-6", "2025-04-06", "16", "Sued"],
    ["R-25", "K-6", "2025-04-06", "16", "Sued"], ["R-26", "K-7", "April", "13", "Sued"], ["R-27", "K-8", "2025-04-08", "12", "West"],
    ["R-28", "K-9", "2025-04-09", "11", "West"], ["R-29", "K-10", "2025-04-10", "14", "West"],
]
IDS = ["order_id", "customer_id"]


@pytest.fixture()
def orders(spark):
    return text_frame(spark, NAMES, ROWS)


def test_issues_of_a_known_table(orders):
    found = {r.issue_id: (r.check, r.severity, r.affected) for r in quality.issues(orders).collect()}
    assert found == {
        "duplicate-rows": ("duplicate_rows", "high", 1),
        "identifier-duplicates-0": ("key_grain", "medium", 2),
        "identifier-duplicates-1": ("key_grain", "high", 2),
        "missing-1": ("completeness", "high", 1),
        "missing-4": ("completeness", "medium", 1),
        "invalid-date-2": ("validity", "high", 1),
        "outlier-3": ("outlier", "medium", 1),
    }


def test_few_values_are_skipped_not_passed(spark):
    small = text_frame(spark, ["order_id", "amount"], [[f"O-{i}", str(i)] for i in range(5)])
    stats = quality.column_stats(small)
    assert [r.field for r in quality.skipped_checks(stats, ["order_id"]).collect()] == ["amount"]
    assert quality.summary(quality.issues(small), stats, ["order_id"]).first().checks_run == 4


def test_summary(orders):
    row = quality.summary(quality.issues(orders), quality.column_stats(orders), IDS).first()
    assert (row.checks_run, row.passed_checks, row.high, row.medium, row.low) == (5, 0, 4, 3, 0)


def test_cleaning_receipt_and_result(orders):
    plan = [Repair("drop_missing", "customer_id"), Repair("drop_missing", "region"),
            Repair("drop_invalid_date", "purchase_date"), Repair("deduplicate_exact")]
    assert [(r.action, r.affected_rows) for r in cleaning.receipt(orders, plan).collect()] == [
        ("deduplicate_exact", 1), ("drop_missing(customer_id)", 1), ("drop_missing(region)", 1),
        ("drop_invalid_date(purchase_date)", 1)]
    kept = cleaning.clean_or_refuse(orders, plan)
    assert kept.count() == 7
    both = cleaning.before_and_after(orders, kept).first()
    assert (both.source_rows, both.result_rows, both.removed_rows, both.issues_before, both.issues_after,
            both.checks_skipped_after) == (11, 7, 4, 7, 0, 1)


def test_receipt_without_deduplication_counts_copies(orders):
    twice = orders.unionByName(orders)
    rows = cleaning.receipt(twice, [Repair("drop_missing", "region")]).collect()
    assert [(r.action, r.affected_rows, r.rows_after) for r in rows] == [("drop_missing(region)", 2, 20)]


def test_missing_dates_are_not_invalid(spark):
    df = text_frame(spark, ["d"], [["2024-01-01"], [""], [None], ["x"]])
    assert cleaning.clean(df, [Repair("drop_invalid_date", "d")]).count() == 3


def test_keep_first_with_a_row_on_a_third_of_the_table(spark):
    df = spark.range(9000).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, F.lit(" same ")).otherwise(F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))).alias("a"),
    ).repartition(8)
    kept = cleaning.keep_first(df, ["n"])
    expected = {}
    for i in range(9000):
        expected.setdefault("same" if i % 3 == 0 else f"v{i % 50}", i)
    assert {r.a.strip(): r.n for r in kept.collect()} == expected
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()


def test_profile_keys_and_grain(spark):
    df = text_frame(spark, ["order_id", "item_id", "note"], [["O-1", "I-1", " "], ["O-1", "I-2", "x"], ["O-2", "I-3", "x"]])
    found = {r.column: (r.unique, r.candidate_key) for r in profile.column_profile(df).collect()}
    assert found == {"order_id": (2, False), "item_id": (3, True), "note": (1, False)}
    assert profile.grain(profile.column_profile(df)).first().grain == "one row per order item"
    sketch = profile.column_profile(df, exact=False).collect()
    assert all(r.candidate_key is None for r in sketch)


def test_unique_counts_are_untrimmed(spark):
    df = text_frame(spark, ["a"], [["x"], [" x"], ["X"]])
    assert profile.column_profile(df).first().unique == 3


def test_long_values_are_told_apart(spark):
    long = "x" * 200
    df = text_frame(spark, ["a"], [[long + "1"], [long + "2"], [long + "1"]])
    assert profile.column_profile(df).first().unique == 2
    assert [r.example for r in profile.examples(df).collect()] == ["x" * 27 + "…"]


def test_fingerprint_ignores_order_but_not_content(spark, orders):
    def mark(df):
        return profile.fingerprint(df, "t").first().fingerprint

    assert mark(orders) == mark(orders.repartition(5).sortWithinPartitions("amount"))
    assert mark(orders) != mark(orders.withColumn("region", F.concat("region", F.lit("."))))
    pair = orders.limit(1)
    assert mark(orders) != mark(orders.unionByName(pair).unionByName(pair))  # XOR alone would not notice
    assert mark(orders) != mark(orders.withColumnRenamed("region", "area"))
    moved = spark.createDataFrame([("x", None)], "a string, b string"), spark.createDataFrame([(None, "x")], "a string, b string")
    assert mark(moved[0]) != mark(moved[1])
    one, two = profile.fingerprint(orders, "t"), profile.fingerprint(orders.repartition(3), "t")
    assert profile.same_versions(one, two) and not profile.same_versions(one, profile.fingerprint(pair, "t"))


def test_roles(orders):
    row = profile.suggest_roles(profile.column_profile(orders)).first()
    assert (row.entity, row.order_entity, row.value, row.time, row.status) == (
        "order_id", "order_id", "amount", "purchase_date", None)


def test_exact_quantiles(spark):
    """Skewed data with a value on a third of the rows, NULLs and extreme values."""
    values = [7.25 if i % 3 == 0 else (i * 7919 % 10007) / 4 for i in range(5000)] + [1e300, -1e300, 1e-300]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 100, "v double").repartition(5)
    fractions = [0.0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.999, 1.0]
    n, got = order_stats.quantiles(df, ["v"], fractions)["v"]
    ranked = sorted(values)
    assert n == len(values)
    for f, q in zip(fractions, got):
        place = (len(ranked) - 1) * f
        low = int(place)
        high = min(low + 1, len(ranked) - 1)
        assert q == pytest.approx(ranked[low] + (place - low) * (ranked[high] - ranked[low]))
    rank = -(-len(ranked) * 95 // 100)
    assert order_stats.nearest_rank(df, "v", 0.95) == ranked[rank - 1]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert order_stats.quantiles(df, ["v"], [0.5]) == {"v": (0, [None])}
    assert order_stats.nearest_rank(df, "v", 0.95) is None


ISSUES = [
    ("duplicate-rows", "duplicate_rows", None), ("order-duplicate", "key_grain", "order_id"),
    ("customer-duplicate", "key_grain", "customer_id"), ("customer-missing", "completeness", "customer_id"),
    ("date-invalid", "validity", "purchase_date"), ("amount-outlier", "outlier", "amount"),
    ("region-missing", "completeness", "region"),
]
COUNT = dict(name="去重订单量", kind="count", entity="order_id", time="purchase_date", scope="order_id 非空的全部记录",
             question="判断订单编号的总体规模")


@pytest.fixture()
def found(spark):
    return spark.createDataFrame(ISSUES, "issue_id string, check string, field string")


def levels(df):
    return {r.issue_id: r.level for r in df.collect()}


def test_distinct_count_is_not_affected(found):
    row = impact.rollup(impact.assess(found, MetricContext(**COUNT))).first()
    assert (row.affecting, row.review, row.unrelated) == (0, 0, 7)


def test_amount_trend_and_ratio_impacts(found):
    amount = levels(impact.assess(found, MetricContext(**{**COUNT, "kind": "amount", "value": "amount", "name": "订单金额总额",
                                                          "question": "判断全部订单金额规模"})))
    assert (amount["duplicate-rows"], amount["amount-outlier"], amount["order-duplicate"]) == ("affecting", "affecting", "review")
    trend = levels(impact.assess(found, MetricContext(**{**COUNT, "name": "月度去重订单量", "question": "比较每月订单趋势"})))
    assert trend["date-invalid"] == "affecting"
    share = levels(impact.assess(found, MetricContext(**{**COUNT, "kind": "ratio", "name": "华东订单占比",
                                                         "extra_scope": "分子条件：region 等于华东"})))
    assert share["region-missing"] == "affecting"
    unsure = levels(impact.assess(found, MetricContext(**COUNT, grain_confirmed=False)))
    assert unsure["order-duplicate"] == "review"


def test_open_fields_need_review(found):
    open_one = Analysis("group_compare", "sum", "order_id", group="region")
    assert set(levels(impact.review_for(found, open_one, "q")).values()) == {"review"}
    ready = Analysis("group_compare", "count_distinct", "order_id", group="region")
    assert levels(impact.review_for(found, ready, "q", confirmed=True))["region-missing"] == "affecting"


def test_gate(spark, orders):
    issues = quality.issues(orders)
    none = spark.createDataFrame([], "issue_id string, decision string")
    gate = quality.execution_gate(quality.decision_rollup(issues, none), repairs_applied=False).first()
    assert (gate.undecided, gate.ready) == (7, False)
    everything = issues.select("issue_id", F.lit("approved").alias("decision"))
    rollup = quality.decision_rollup(issues, everything)
    assert (rollup.first().approved_repairs, rollup.first().reviewed) == (4, 3)
    assert quality.execution_gate(rollup, False).first().ready is False
    assert quality.execution_gate(rollup, True).first().ready is True
    assert all(r.passed for r in quality.gate_checks(quality.execution_gate(rollup, True)).collect())


def test_control_totals(orders):
    row = profile.control_totals(orders, "order_id", "amount", "region").first()
    assert (row.rows, row.distinct_entities, row.repeated_entities, row.duplicate_row_groups) == (11, 10, 1, 1)
    assert (row.amount_total, row.amount_without_group, row.rows_without_group, row.reconciled) == (936.0, 15.0, 1, True)


def test_digest_and_text_keep_every_digit(spark):
    """Rows one microsecond apart are no copies; doubles print plainly and are read back as numbers."""
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00.000001' AS t UNION ALL SELECT timestamp'2024-01-01 00:00:00.000002'")
    assert df.select(cells.row_digest(df)).distinct().count() == 2
    df = spark.createDataFrame([(12345678.9,), (2.5,), (0.0001,), (-1e-7,), (3.0,)], "v double")
    assert [r[0] for r in df.select(cells.raw_text(df, "v")).collect()] == ["12345678.9", "2.5", "0.0001", "-0.0000001", "3"]
    huge = text_frame(spark, ["v"], [["9" * 400], ["5"]])
    assert [r[0] for r in huge.select(cells.number(huge, "v")).collect()] == [None, 5.0]
