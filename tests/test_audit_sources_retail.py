import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frames import passed, text_frame
from grainwise.operators import audit
from grainwise.plans import retail
from grainwise.plans.retail import Retail
from grainwise.session import cut_lineage
from grainwise.sources import csv, intake, sinks


def test_redaction(spark):
    deep = "struct<a:struct<b:struct<c:struct<d:struct<e:struct<f:string>>>>>>"
    schema = f"id int, rows string, Api_Key string, note string, tags array<string>, args map<string,string>, call {deep}"
    nest = ((((((("x",),),),),),),)
    df = spark.createDataFrame([(1, "r", "k", "n" * 600, [str(i) for i in range(30)], {"password": "p", "sql": "s"}, nest[0])], schema)
    row = audit.redact(df).first().asDict(recursive=True)
    assert set(row) == {"id", "note", "tags", "args", "call"}
    assert row["note"] == "n" * 500 + "…[truncated]"
    assert row["tags"] == {"item_count": 30, "items": ["0", "1", "2"]}
    assert row["args"] == {"sql": "s"}
    assert row["call"]["a"]["b"]["c"]["d"]["e"] == "[nested too deeply]"


def test_checksum_is_canonical_and_notices_changes(spark):
    a = spark.createDataFrame([(1, None, "x")], "b int, a string, c string")
    b = a.select("c", "a", "b")
    assert audit.sealed(a).first().checksum == audit.sealed(b).first().checksum
    assert audit.seal_checks(audit.sealed(a)).first().intact
    assert not audit.seal_checks(audit.sealed(a).withColumn("c", F.lit("y"))).first().intact
    blank = a.withColumn("a", F.lit(""))
    assert audit.sealed(a).first().checksum != audit.sealed(blank).first().checksum


def test_evidence_cap(spark):
    rows = audit.capped_groups(spark.range(250).select(F.col("id").alias("value")), [F.col("value").desc()])
    assert rows.count() == 100 and rows.first().asDict() == {"value": 249, "group_count": 250, "truncated": True}


def test_plan_changes(spark):
    df = spark.createDataFrame([(1, "decision", "trend", None), (1, "compiled", "trend", "amount"), (1, "guarded", "metric", "amount")],
                               "plan int, stage string, analysis string, value string")
    got = {(r.stage, r.field, r.before, r.after) for r in
           audit.plan_changes(df, "plan", "stage", ["decision", "compiled", "guarded"], ["analysis", "value"]).collect()}
    assert got == {("compiled", "value", None, "amount"), ("guarded", "analysis", "trend", "metric")}


def test_completed_tasks_are_frozen(spark):
    df = spark.createDataFrame([("t", "PLANNING", 1), ("t", "COMPLETED", 2), ("t", "EXPORT", 3), ("u", "PLANNING", 9)],
                               "task string, state string, at int")
    assert {(r.task, r["at"]) for r in audit.frozen_events(df, "task", "state", "at").collect()} == {("t", 1), ("t", 2), ("u", 9)}


def test_csv_scan_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        "﻿order_id, name ,,name\r\nO-1,\"a, \"\"b\"\"\nc\",x,y\r\n , ,null,\r\nO-2,,z,\r\n".encode())
    df = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["order_id", "name", "未命名列 3", "name（2）"]
    assert all(f.dataType == T.StringType() for f in df.schema)
    rows = df.collect()
    assert [r[0] for r in rows] == ["O-1", "O-2"] and rows[0][1] == 'a, "b"\nc'
    with pytest.raises(csv.EmptyTable):
        csv.require_data(df.filter("false"))


def test_delimiter_survey_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n  \nx;y;z\n1,2;3\n")
    (tmp_path / "b.csv").write_text('"q,r,s"\tt\n1\t2\n')
    (tmp_path / "c.csv").write_text("only\n")
    got = {r.file.rsplit("/", 1)[1]: r.delimiter for r in csv.delimiter_survey(csv.lines(spark, str(tmp_path))).collect()}
    assert got == {"a.csv": ";", "b.csv": "\t", "c.csv": ","}


@pytest.mark.parametrize("rows, header_row, names", [
    ([["字段", "含义"], ["order_id", "订单编号"], ["amount", "订单金额"], ["region", "客户地区"]], 1, ["字段", "含义"]),
    ([["2026 年销售明细", None, None], ["order_id", "amount", "region"], ["O-1", "100", "华东"]], 2, ["order_id", "amount", "region"]),
    ([["x", "x", ""], ["1", "2", "3"]], 2, ["1", "2", "3"]),
])
def test_header_survey(spark, rows, header_row, names):
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file string, place int, cells array<string>")
    row = csv.header_survey(df).first()
    assert (row.header_row, row.names) == (header_row, names)


def test_header_names_match_on_both_sides(spark):
    raw = ["a", " ", "a", None, "b ", "a"]
    df = spark.createDataFrame([(raw,)], "c array<string>")
    assert df.select(csv.header_names(F.col("c"))).first()[0] == csv.clean_names(raw) == [
        "a", "未命名列 2", "a（2）", "未命名列 4", "b", "a（3）"]


def test_intake(spark, tmp_path):
    wide = text_frame(spark, ["a", "b", "c"], [["1", "2", "3"], ["x\u0000", None, None]])
    assert passed(csv.intake_checks(wide, max_rows=1, max_columns=2)) == {
        "has_rows": True, "rows_within_limit": False, "columns_within_limit": False, "no_binary_content": False}
    assert all(passed(csv.intake_checks(wide.limit(1))).values())
    (tmp_path / "ok.csv").write_text("a\n1\n")
    (tmp_path / "no.xlsx").write_text("zip")
    got = {r.file.rsplit("/", 1)[1]: (r.extension_ok, r.size_ok) for r in csv.file_checks(spark, str(tmp_path), 3).collect()}
    assert got == {"ok.csv": (True, False), "no.xlsx": (False, True)}


def test_scan_tables_and_manifest(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("extra,order_id,at\nq,o1,2024-01-01 10:00:00\n,o2,\n")
    schema = T.StructType([T.StructField("order_id", T.StringType()), T.StructField("at", T.TimestampType())])
    tables = csv.scan_tables(spark, str(tmp_path), {"orders": schema})
    assert tables["orders"].columns == ["order_id", "at"]
    assert tables["orders"].first()["at"] == dt.datetime(2024, 1, 1, 10)
    assert {(r.source, r.rows) for r in csv.manifest(tables).collect()} == {("orders", 2), ("(total)", 2)}
    with pytest.raises(FileNotFoundError, match="gone, items"):
        csv.scan_tables(spark, str(tmp_path), {"orders": schema, "items": schema, "gone": schema})


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, -5.0, '=SUM(A1)', 'a "b", c'), (2, None, None, "line\nbreak"), (3, 1.5e-7, " x ", "")], "order_id int, amount double, note string, `=h` string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert raw == ("order_id,amount,note,'=h\n" '1,-5,\'=SUM(A1),"a ""b"", c"\n' '2,,,"line\nbreak"\n' "3,0.00000015, x ,\n")


def test_csv_sink_of_an_empty_result_and_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "order_id int, note string")
    sinks.write_csv(df.filter("order_id > 1"), str(tmp_path / "empty"), bom=True)
    assert [f.read_bytes().decode() for f in (tmp_path / "empty").glob("part-*")] == ["\ufefforder_id,note\n"]
    sinks.write_csv(spark.createDataFrame([], df.schema), str(tmp_path / "none"))
    assert [f.read_bytes().decode() for f in (tmp_path / "none").glob("part-*")] == ["order_id,note\n"]
    sinks.write_csv(df, str(tmp_path / "marked"), bom=True)
    assert intake.read(spark, str(tmp_path / "marked")).rows.collect() == [("1", "x")]


def test_every_csv_file_has_the_header_once_and_reads_back(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit('x, "'), F.col("id").cast("string"), F.lit("\n")).alias("note"))
    sinks.write_csv(df.repartition(4, "id"), str(tmp_path / "out"))
    files = [f.read_bytes().decode() for f in (tmp_path / "out").glob("part-*")]
    assert len(files) > 1 and all(f.startswith("id,note\n") and f.count("id,note") == 1 for f in files)
    for back in (csv.read_csv(spark, str(tmp_path / "out")), intake.read(spark, str(tmp_path / "out")).rows):
        assert {(int(r.id), r.note) for r in back.collect()} == {(r.id, r.note) for r in df.collect()}


def test_intake_of_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a 1.csv").write_bytes("\ufeffMonthly report\r\n\r\norder_id,name,amount\r\nO-1,x,5,late,very\r\n , ,null\r\nO-2,,7\r\n".encode())
    (tmp_path / "b.csv").write_text('amount;order_id;region\n1,5;O-3;"N;""S"\n2;"O\n-4";E\n')
    (tmp_path / "c.csv").write_text('order_id\tfile\tname\nO-5\tf\t"a;b,c"\n')
    (tmp_path / "d.csv").write_text('name,order_id,name\n"x\n,y",O-6,z,"p\nq",r\n')
    found = intake.read(spark, str(tmp_path))
    assert found.rows.columns == ["order_id", "name", "amount", "未命名列 4", "未命名列 5", "region", "file", "name（2）"]
    assert {tuple(r) for r in found.rows.collect()} == {
        ("O-1", "x", "5", "late", "very", None, None, None), ("O-2", None, "7", None, None, None, None, None),
        ("O-3", None, "1,5", None, None, 'N;"S', None, None), ("O\n-4", None, "2", None, None, "E", None, None),
        ("O-5", "a;b,c", None, None, None, None, "f", None), ("O-6", "x\n,y", None, "p\nq", "r", None, None, "z")}
    how = {r.file.rsplit("/", 1)[1][0]: (r.delimiter, r.multiline, r.width, r.header_row) for r in found.survey.collect()}
    assert how == {"a": (",", False, 5, 2), "b": (";", True, 3, 1), "c": ("\t", False, 3, 1), "d": (",", True, 5, 1)}


def test_intake_of_large_files_is_split_and_empty_ones_are_refused(spark, tmp_path):
    lines = ["a title;", "order_id;amount"] + [f"O-{i};{i}" for i in range(20_000)]
    (tmp_path / "big.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = intake.read(spark, str(tmp_path)).rows
        assert rows.agg(F.count("*"), F.countDistinct("order_id"), F.sum(F.col("amount").cast("int"))).first() == (20_000, 20_000, 199_990_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("\n \n")
    with pytest.raises(csv.EmptyTable):
        intake.read(spark, str(tmp_path / "none"))


def test_events_without_a_task_are_not_frozen(spark):
    df = spark.createDataFrame([(None, "COMPLETED", 1), (None, "PLANNING", 2), ("t", "COMPLETED", 1), ("t", "PLANNING", 2)], "task string, state string, at int")
    assert {(r.task, r["at"]) for r in audit.frozen_events(df, "task", "state", "at").collect()} == {(None, 1), (None, 2), ("t", 1)}


def test_pages(spark):
    df = spark.range(30).select(F.col("id").alias("k"))
    second = sinks.page(df, [F.col("k").asc()], 1).collect()
    assert [(r.k, r.row_number) for r in second] == [(25 + i, 26 + i) for i in range(5)]
    assert sinks.page_after(df, "k", 24, 25).collect() == second
    assert sinks.page_after(df, "k", None, 0).count() == 25


def shop(spark):
    day = dt.datetime
    orders = spark.createDataFrame([
        ("o1", "c1", "delivered", day(2017, 1, 5), day(2017, 1, 10), day(2017, 1, 8)),
        ("o2", "c2", "delivered", day(2017, 1, 20), day(2017, 1, 22), day(2017, 1, 30)),
        ("o3", "c3", "shipped", day(2017, 1, 21), None, day(2017, 2, 1)),
        ("o4", "c4", "delivered", day(2017, 2, 1), None, day(2017, 2, 9)),
        ("o5", "c5", "delivered", day(2016, 12, 31), day(2017, 1, 2), day(2017, 1, 3)),
    ], "order_id string, customer_id string, status string, purchased_at timestamp, delivered_at timestamp, promised_at timestamp")
    items = spark.createDataFrame([("o1", 1, "p1", 10.0, 1.0), ("o1", 2, "p2", 20.0, 1.0), ("o2", 1, "p1", 5.0, 1.0),
                                   ("o3", 1, "p1", 99.0, 1.0), ("o5", 1, "p3", 7.0, 1.0), ("o4", 1, "p3", 15.0, 1.0)],
                                  "order_id string, item_no int, product_id string, price double, freight double")
    customers = spark.createDataFrame([(f"c{i}", "b1" if i < 3 else f"b{i}") for i in range(1, 6)], "customer_id string, buyer_id string")
    products = spark.createDataFrame([("p1", "cama"), ("p2", "novo"), ("p3", None)], "product_id string, category_code string")
    categories = spark.createDataFrame([("cama", "bed")], "category_code string, category string")
    reviews = spark.createDataFrame([("o1", 5), ("o1", 2), ("o2", 4), ("o9", 1)], "order_id string, score int")
    return Retail(orders, items, customers, products, categories, reviews, "2017-01-01", "2018-09-01")


def test_retail(spark):
    r = shop(spark)
    k = retail.kpis(r).first()
    assert (k.total_orders, k.delivered_orders, k.delivered_rate, k.delivered_buyers) == (4, 3, 0.75, 2)
    assert (k.product_gmv, k.average_order_value, k.average_delivery_days) == (50.0, 16.67, 3.5)
    assert [tuple(x) for x in retail.monthly(r).collect()] == [("2017-01", 3, 2, 35.0, 0.04), ("2017-02", 1, 1, 15.0, 0.02)]
    top = [(x.rank, x.category, x.product_gmv, x.delivered_orders, x.item_count) for x in retail.top_categories(r).collect()]
    assert top == [(1, "novo", 20.0, 1, 1), (2, "bed", 15.0, 2, 2), (3, "unknown", 15.0, 1, 1)]
    reviews = {x.delivery: (x.reviewed_orders, x.negative_orders) for x in retail.delivery_reviews(r).collect()}
    assert reviews == {"late": (1, 1), "on_time": (1, 0)}
    risk = retail.delivery_risk(r).first()
    assert (risk.rate_gap, risk.risk_ratio) == (1.0, None)
    assert retail.peak_month(r).first().month == "2017-01"
    assert retail.top_share(r).first().combined_share == 1.0
    assert all(x.passed for x in retail.validations(r).collect())


def test_retail_validations_find_defects(spark):
    r = shop(spark)
    bad = Retail(r.orders.unionByName(r.orders.limit(1)), r.items.unionByName(r.items.limit(1)).filter("order_id <> 'o4'"),
                 r.customers, r.products, r.categories, r.reviews, r.start, r.end)
    failed = {x.check for x in retail.validations(bad).collect() if not x.passed}
    assert {"orders_primary_key", "items_composite_key", "delivered_items_matched", "reviews_at_order_grain"} <= failed
    with pytest.raises(Exception, match="not unique"):
        retail.delivered_orders(bad, strict=True).collect()


def test_snapshot_is_one_nested_row(spark, tmp_path):
    frame = retail.snapshot(shop(spark))
    sinks.write_snapshot(frame, str(tmp_path / "snap"))
    report = json.loads(next((tmp_path / "snap").glob("part-*.json")).read_text())
    assert report["kpis"]["product_gmv"] == 50.0 and len(report["monthly"]) == 2 and len(report["validation"]) == 8
    assert {"source": "orders", "rows": 5} in report["sources"]


def test_undefined_metric():
    assert len(retail.DEFINITIONS) == 10
    with pytest.raises(KeyError):
        retail.definition("profit")


def test_lineage_is_cut_into_the_shared_folder(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.rand(1)))
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir().startswith("file:" + spark.conf.get("spark.checkpoint.dir"))
