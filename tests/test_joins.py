import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from frames import passed, text_frame
from grainwise.operators import joins, keys, reconcile
from grainwise.operators.joins import JoinRefused, JoinSpec, Step

BY_ORDER = [("order_id", "order_id")]
BY_CUSTOMER = [("customer_id", "customer_id")]


@pytest.fixture()
def tables(spark):
    orders = spark.createDataFrame(
        [("K3", "P2", 90), ("K1", "P1", 70), ("K5", "P2", 10), ("K4", "P9", 25), ("K2", "P1", 30)],
        "order_id string, customer_id string, amount int")
    items = text_frame(spark, ["order_id", "item_id", "category"], [
        ["K8", "i6", "D"], ["K1", "i1", "A"], ["K1", "i2", "B"], ["K2", "i4", "A"], ["K1", "i3", "A"], ["K3", "i5", "C"]])
    customers = text_frame(spark, ["customer_id", "region"], [["P3", "North"], ["P1", "East"], ["P2", "South"]])
    return {"orders": orders, "items": items, "customers": customers}


def test_key_profiles(tables):
    assert keys.key_profile(tables["orders"], ["order_id"]).first().unique is True
    row = keys.key_profile(tables["items"], ["order_id"]).first()
    assert (row.unique, row.duplicated_keys, row.rows_in_duplicated_keys) == (False, 1, 3)
    assert keys.key_profile(tables["items"], ["order_id", "item_id", "category"]).first().unique is True
    with pytest.raises(ValueError):
        keys.key_profile(tables["items"], ["order_id", "order_id"])


def test_one_to_many(tables):
    row = keys.relationship(tables["orders"], tables["items"], BY_ORDER).first()
    assert (row.cardinality, row.left_orphan_rows, row.right_orphan_rows) == ("1:N", 2, 1)
    assert (row.left_join_rows, row.expansion, row.measure_risk, row.inner_join_rows) == (7, 1.4, True, 5)


def test_many_to_one(tables):
    row = keys.relationship(tables["orders"], tables["customers"], BY_CUSTOMER).first()
    assert (row.cardinality, row.left_orphan_rows, row.right_orphan_rows, row.measure_risk) == ("N:1", 1, 1, False)


def test_many_to_many_is_blocked(spark):
    left, right = text_frame(spark, ["key"], [["A"], ["A"]]), text_frame(spark, ["key"], [["A"], ["a "]])
    row = keys.relationship(left, right, [("key", "key")]).first()
    assert (row.cardinality, row.blocked, row.left_join_rows) == ("N:N", True, 4)
    spec = JoinSpec((("key", "key"),), "left", "N:N").confirm("x")
    with pytest.raises(JoinRefused, match="not_many_to_many"):
        joins.controlled_join(left, right, spec, "l", "r")


def test_composite_key(spark):
    left = spark.createDataFrame([("O-1", 1, 10), ("O-1", 2, 20)], "order_id string, seq int, amount int")
    right = spark.createDataFrame([("O-1", 1, "ok"), ("O-1", 2, "ok")], "order_id string, seq int, status string")
    row = keys.relationship(left, right, [("order_id", "order_id"), ("seq", "seq")]).first()
    assert (row.cardinality, row.left_coverage) == ("1:1", 1.0)


def test_null_key_degrades_cardinality(spark):
    left = text_frame(spark, ["k"], [["a"], ["a"], ["b"]])
    right = text_frame(spark, ["k"], [["a"], ["b"], ["null"]])
    row = keys.relationship(left, right, [("k", "k")]).first()
    assert (row.cardinality, row.right_null_rows, row.right_orphan_rows, row.right_orphan_keys) == ("N:N", 1, 1, 0)


def test_text_one_is_not_number_one(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = text_frame(spark, ["k"], [["1"], ["2"]])
    assert keys.relationship(left, right, [("k", "k")]).first().matched_left_rows == 0
    assert joins.equi_join(left, right, JoinSpec((("k", "k"),)), "l", "r").filter("matched").count() == 0


def test_candidates(tables):
    found = {(r.left_table, r.right_table, r.left_fields, r.cardinality, r.score)
             for r in keys.join_candidates(tables).collect()}
    assert found == {("orders", "items", "order_id", "1:N", 3), ("orders", "customers", "customer_id", "N:1", 2)}
    bridge = keys.bridge_candidates({k: tables[k] for k in ("orders", "items")}, "customers", tables["customers"]).collect()
    assert [(r.left_table, r.left_fields) for r in bridge] == [("orders", "customer_id")]
    assert keys.join_candidates({"a": tables["items"].select("category"), "b": tables["customers"].select("region")}) is None


def test_many_relationships_at_once_equal_each_alone(spark):
    a = spark.createDataFrame(
        [(1, 1.0, " X", "p", None, dt.date(2024, 1, 1)), (2, -0.0, "x", "q", [1], None), (2, 2.5, "null", "q", [1], dt.date(2024, 1, 2)), (None, None, "y", "r", [2], None)],
        "i int, d double, t string, u string, v array<int>, day date")
    b = spark.createDataFrame(
        [(1, Decimal(1), "x", "p", [1], dt.datetime(2024, 1, 1)), (2, Decimal(0), "1", "q", [1], None), (5, None, "y", None, None, dt.datetime(2024, 1, 2, 5))],
        "i bigint, d decimal(5,2), t string, u string, v array<int>, day timestamp")
    tables = {"a": a, "b": b, "none": a.limit(0), "empty": b.limit(0)}
    ons = [[(c, c)] for c in a.columns] + [[("i", "t")], [("t", "i")], [("i", "i"), ("u", "u")], [("t", "t"), ("d", "d")], [("u", "t"), ("day", "day")]]
    wanted = [(x, y, on) for x, y in (("a", "b"), ("a", "empty"), ("none", "b"), ("none", "empty")) for on in ons]
    got = {(r.left_table, r.right_table, r.left_fields, r.right_fields): r.asDict() for r in keys.relationships(tables, wanted).collect()}
    assert len(got) == len(wanted)
    for x, y, on in wanted:
        alone = keys.relationship(tables[x], tables[y], on).first().asDict()
        row = got[x, y, "+".join(c for c, _ in on), "+".join(c for _, c in on)]
        assert {k: row[k] for k in alone} == alone, (x, y, on)


def test_candidates_scan_each_table_once(spark, tmp_path):
    tables = {}
    for name in ("x", "y", "z"):
        spark.range(50).selectExpr("id AS a_id", "id % 7 AS b_id", "id AS c_id", "'w' AS other").write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    found = keys.join_candidates(tables)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and "other" not in found._jdf.queryExecution().sparkPlan().toString()
    # Three tables, three pairs of them, three single fields and the composites that hold a unique field.
    assert sum("+" not in r.left_fields for r in found.collect()) == 9 and found.count() == 18


def test_every_common_key_is_a_candidate(spark):
    """Nine common columns give nine single candidates."""
    names = [f"k{i}_id" for i in range(9)]
    left, right = (text_frame(spark, names, [[f"{side}{i}" for i in range(9)]]) for side in "lr")
    singles, composites = keys.candidate_pairs(left, right)
    assert len(singles) == 9 and len(composites) == 36


def test_unconfirmed_join_is_refused(tables):
    draft = joins.propose(tables["orders"], tables["customers"], BY_CUSTOMER)
    assert (draft.how, draft.cardinality, draft.grain) == ("left", "N:1", "left")
    with pytest.raises(JoinRefused, match="spec_confirmed"):
        joins.controlled_join(tables["orders"], tables["customers"], draft, "o", "c")


def test_safe_join_keeps_amounts(tables):
    orders, customers = tables["orders"], tables["customers"]
    spec = joins.propose(orders, customers, BY_CUSTOMER).confirm("one row per order")
    assert joins.preview(orders, customers, spec).first().output_rows == 5
    joined = joins.controlled_join(orders, customers, spec, "orders", "customers")
    rows = {r.orders__order_id: (r.customers__region, r.matched) for r in joined.collect()}
    assert rows == {"K1": ("East", True), "K2": ("East", True), "K3": ("South", True), "K4": (None, False), "K5": ("South", True)}
    assert all(passed(joins.structural_checks(joined, keys.relationship(orders, customers, BY_CUSTOMER), spec)).values())
    amounts = reconcile.reconcile_join(orders, customers, BY_CUSTOMER, "left", ["amount"], [], "orders", "customers")
    row = amounts.first()
    assert (row.status, row.source_total, row.output_total) == ("balanced", 225.0, 225.0)
    reconcile.require_balanced(amounts, "orders", "amount")


def test_fan_out_is_found_and_blocks_sums(tables):
    orders, items = tables["orders"], tables["items"]
    spec = joins.propose(orders, items, BY_ORDER).confirm("one row per matched item")
    assert (spec.how, spec.grain) == ("inner", "right")
    assert joins.controlled_join(orders, items, spec, "o", "i").count() == 5
    amounts = reconcile.reconcile_join(orders, items, BY_ORDER, "inner", ["amount"], [], "orders", "items")
    row = amounts.first()
    assert (row.status, row.source_total, row.output_total, row.net_delta) == ("mixed", 225.0, 330.0, 105.0)
    assert (row.duplicated_source_rows, row.excluded_source_rows, row.duplication_impact, row.exclusion_impact) == (1, 2, 140.0, 35.0)
    with pytest.raises(reconcile.UnsafeAmount):
        reconcile.require_balanced(amounts, "orders", "amount")


def test_left_join_may_not_mix_grains(tables):
    unsafe = JoinSpec(tuple(BY_ORDER), "left", "1:N", "left").confirm("one row per order")
    rel = keys.relationship(tables["orders"], tables["items"], BY_ORDER)
    failed = {k for k, ok in passed(joins.validation(rel, unsafe)).items() if not ok}
    assert failed == {"grain_kept_by_join", "no_orphans_in_right_grain"}
    moved = JoinSpec(tuple(BY_ORDER), "left", "1:N", "left", versions=("a", "b")).confirm("x")
    assert passed(joins.validation(rel, moved, ("a", "c")))["versions_unchanged"] is False


def test_enrichment_keeps_the_left_grain(tables):
    orders, items = tables["orders"], tables["items"]
    spec = JoinSpec(tuple(BY_ORDER), "left", "1:N", "left").confirm("one row per order")
    rel = keys.relationship(orders, items, BY_ORDER)
    assert all(passed(joins.enrichment_validation(rel, spec, ["category"], {"category": "text"})).values())
    assert not passed(joins.enrichment_validation(rel, spec, [], {}))["some_field"]
    assert not passed(joins.enrichment_validation(rel, spec, ["amount"], {"amount": "number"}))["descriptive_fields_only"]
    out = joins.enrich(orders, items, spec, ["category"], "orders", "items")
    rows = {r.orders__order_id: (r.items__category_values, r.items__category_distinct_list, r.matched) for r in out.collect()}
    assert rows["K1"] == (["A", "B"], "A、B", True) and rows["K4"] == ([], None, False)
    amounts = reconcile.reconcile_rows(out, orders, "order_id", "orders__order_id", ["amount"], "orders")
    assert amounts.first().status == "balanced"
    bad = reconcile.unbalanced(amounts).agg(F.count(F.lit(1))).scalar()
    assert all(passed(joins.enrichment_checks(orders, out, rel, bad)).values())


def test_enrichment_merges_spellings_and_keeps_empty_keys(spark):
    left = text_frame(spark, ["k"], [["a"], ["b"], [None], ["null"]])
    right = text_frame(spark, ["k", "c"], [["A ", "x"], ["a", " X"], ["a", "y"], ["b", ""], [None, "z"]])
    out = joins.enrich(left, right, JoinSpec((("k", "k"),), "left", "1:N"), ["c"], "l", "r")
    assert sorted((r.l__k or "", r.r__c_distinct_list, r.matched) for r in out.collect()) == [
        ("", None, False), ("a", "X、y", True), ("b", None, True), ("null", None, False)]


def test_three_tables(tables):
    t = {k: tables[k] for k in ("items", "orders", "customers")}
    steps = [
        Step("items", "orders", joins.propose(t["items"], t["orders"], BY_ORDER).confirm("one row per item")),
        Step("orders", "customers", joins.propose(t["orders"], t["customers"], BY_CUSTOMER).confirm("items with customer")),
    ]
    out = joins.chain(t, steps)
    rows = {r.items__item_id: (r.orders__order_id, r.customers__region) for r in out.collect()}
    assert len(rows) == 6 and rows["i1"] == ("K1", "East") and rows["i6"] == (None, None)
    assert all(r.no_fan_out for r in joins.step_accounting(t, steps).collect())
    assert joins.intermediate_checks(t, steps).first().keeps_rows
    amounts = reconcile.reconcile_rows(out, t["orders"], "order_id", "orders__order_id", ["amount"], "orders").first()
    assert (amounts.status, amounts.output_total) == ("mixed", 330.0)
    with pytest.raises(JoinRefused):
        joins.chain(t, [steps[1], steps[1]])
    with pytest.raises(JoinRefused):
        joins.chain(t, [steps[0], Step("nowhere", "customers", steps[1].spec)])


def test_control_totals(spark):
    orders = text_frame(spark, ["order_id", "amount"], [["T1", "15"], ["T2", "40"], ["T3", "5"]])
    items = text_frame(spark, ["order_id"], [["T1"], ["T3"], ["T9"], ["T1"]])
    got = {r.scope: (r.rows, r.distinct_entities, r.amount) for r in
           joins.control_totals(orders, items, BY_ORDER, "order_id", "amount").collect()}
    assert got == {"source": (3, 3, 60.0), "left": (4, 3, 75.0), "inner": (3, 2, 35.0)}


def test_asserted_keys_fail_the_job(tables):
    assert keys.assert_unique(tables["orders"], ["order_id"]).count() == 5
    with pytest.raises(Exception, match="not unique"):
        keys.assert_unique(tables["items"], ["order_id"]).collect()


def test_null_and_hot_keys_against_plain_join(spark):
    """A third of the left rows have no key, another third share one."""
    left = spark.range(3000).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, F.lit(" ")).when(F.col("id") % 3 == 1, F.lit("Hot ")).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).alias("k"))
    right = spark.range(50).select(F.concat(F.lit("K"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("hot", 999)], "k string, v bigint"))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.l__n: r.r__v for r in joins.equi_join(left, right, JoinSpec((("k", "k"),)), "l", "r").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    expected = {i: None if i % 3 == 0 else 999 if i % 3 == 1 else (i % 70 if i % 70 < 50 else None) for i in range(3000)}
    assert got == expected


def test_reconciliation_by_key_equals_tracing_rows(spark, tmp_path):
    left = spark.range(400).select(F.col("id"), (F.col("id") % 37).alias("k"), (F.col("id") / 4).alias("price"))
    right = spark.range(90).select((F.col("id") % 45).alias("k"), (F.col("id") * 1.5).alias("cost"))
    left.write.parquet(str(tmp_path / "l"))
    right.write.parquet(str(tmp_path / "r"))
    left = reconcile.with_row_identity(spark.read.parquet(str(tmp_path / "l")))
    right = reconcile.with_row_identity(spark.read.parquet(str(tmp_path / "r")))
    assert left.select("row_ref").distinct().count() == 400
    for how in ("left", "inner"):
        joined = joins.equi_join(left, right, JoinSpec((("k", "k"),), how), "l", "r")
        by_key = {r.field: r for r in reconcile.reconcile_join(left, right, [("k", "k")], how, ["price"], ["cost"]).collect()}
        for side, table, field, column in (("left", left, "price", "l__row_ref"), ("right", right, "cost", "r__row_ref")):
            row = reconcile.reconcile_rows(joined, table, "row_ref", column, [field], side).first()
            assert row.asDict() == by_key[field].asDict()
