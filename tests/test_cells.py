import datetime as dt
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import text_frame
from grainwise.functions import cells
from grainwise.functions.predicates import FilterRule, matched, matches, matches_category
from grainwise.operators import cleaning


def one(spark, value, expression):
    df = text_frame(spark, ["a"], [[value]])
    return df.select(expression(df, "a")).first()[0]


@pytest.mark.parametrize("value", ["", " ", "\t\n", "null", " NULL ", "Undefined", "__null__", "　", "﻿ ", None])
def test_missing_words(spark, value):
    assert one(spark, value, cells.missing) is True
    assert one(spark, value, cells.text) is None


@pytest.mark.parametrize("value", ["NA", "NaN", "-", "0", "none", "nullable"])
def test_present_words(spark, value):
    assert one(spark, value, cells.missing) is False


@pytest.mark.parametrize("value, number", [
    ("1.50", 1.5), (" -3 ", -3.0), (".5", 0.5), ("5.", 5.0), ("1e5", None), ("+5", None), ("1,000", None), ("bad", None),
    ("", None), ("-.5", -0.5), ("　7　", 7.0), ("1d", None), ("Infinity", None),
])
def test_strict_numbers(spark, value, number):
    assert one(spark, value, cells.number) == number


@pytest.mark.parametrize("value, day", [
    ("2024-02-29", dt.date(2024, 2, 29)), ("2024-02-31", None), ("2024/2/3", dt.date(2024, 2, 3)), ("2023-02-29", None),
    ("2024-01-05 10:00", dt.date(2024, 1, 5)), ("2024-01-05T10:00:00Z", dt.date(2024, 1, 5)), ("2024-01-05 soon", None),
    ("not-a-date", None), ("20240105", None), ("0099-01-01", None), (" 2024-1-5 ", dt.date(2024, 1, 5)), ("", None),
])
def test_real_calendar_days(spark, value, day):
    assert one(spark, value, cells.day) == day


@pytest.mark.parametrize("value, kind", [
    ("2024-02-29", "date"), ("2024-02-31", "text"), ("12", "number"), ("TRUE", "boolean"), ("是", "boolean"), ("x", "text"),
    ("null", None),
])
def test_classes(spark, value, kind):
    assert one(spark, value, cells.cell_class) == kind


@pytest.mark.parametrize("day, week", [
    ("2024-12-30", "2025-W01"), ("2021-01-03", "2020-W53"), ("2026-01-01", "2026-W01"), ("2024-01-08", "2024-W02"),
])
def test_iso_weeks(spark, day, week):
    def label(df, n):
        return cells.period_label(cells.period(cells.day(df, n), "week"), "week")

    assert one(spark, day, label) == week
    assert one(spark, "nope", label) is None


def test_typed_columns_skip_text_rules(spark):
    df = spark.sql("SELECT 1.0D AS d, 2L AS n, TIMESTAMP_NTZ '2024-03-01 10:00:00' AS ts, true AS b, float('nan') AS x")
    row = df.select(
        cells.raw_text(df, "d").alias("d"), cells.number(df, "n").alias("n"), cells.day(df, "ts").alias("ts"),
        cells.cell_class(df, "b").alias("b"), cells.number(df, "x").alias("x"),
    ).first()
    assert (row.d, row.n, row.ts, row.b, row.x) == ("1", 2.0, dt.date(2024, 3, 1), "boolean", None)


def test_normalised_columns_are_marked_and_not_trimmed_twice(spark):
    df = text_frame(spark, ["a"], [[" x "], ["null"]])
    once = cells.normalised(df, ["a"])
    assert cells.is_normal(once, "a") and not cells.is_normal(df, "a")
    assert [r.a for r in once.collect()] == ["x", None]
    twice = cells.normalised(once, ["a"])
    assert "trim" not in twice._jdf.queryExecution().analyzed().toString().split("Project")[1]


def test_digest_separates_neighbouring_cells(spark):
    df = text_frame(spark, ["a", "b"], [["x", "yz"], ["xy", "z"], [" x", "yz "], [None, ""], ["", None]])
    digests = [bytes(r[0]) for r in df.select(cells.row_digest(df)).collect()]
    assert digests[0] == digests[2]
    assert len(set(digests)) == 4


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="nul LNU\t　_x1.-", max_size=9), min_size=30, max_size=60))
def test_missing_rule_against_plain_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a string")
    got = {r.i: r.m for r in df.select("i", cells.missing(df, "a").alias("m")).collect()}
    assert got == {i: v.strip(cells.BLANKS).lower() in cells.MISSING_WORDS for i, v in enumerate(values)}


RULES = [
    ("equals", "5", ["5", "5.0", " 5 "]),
    ("not_equals", "x", ["5", "5.0", " 5 ", "40", "2024-01-02", "2024/1/10", "Abc"]),
    ("greater", "5", ["40", "Abc", "x", "X "]),
    ("contains", "B", ["Abc"]),
    ("greater_equal", "2024-01-05", ["5", "5.0", " 5 ", "40", "2024/1/10", "Abc", "x", "X "]),
    ("not_empty", "", ["5", "5.0", " 5 ", "40", "2024-01-02", "2024/1/10", "Abc", "x", "X "]),
]


@pytest.mark.parametrize("operator, operand, expected", RULES)
def test_filter_ladder(spark, operator, operand, expected):
    values = ["5", "5.0", " 5 ", "40", "2024-01-02", "2024/1/10", "Abc", "x", "X ", "", "null", None]
    df = text_frame(spark, ["a"], [[v] for v in values])
    rule = FilterRule("a", operator, operand)
    kept = [r.a for r in df.filter(matches(df, rule)).collect()]
    assert kept == expected
    assert df.filter(~matched(df, rule)).count() == len(values) - len(expected)


def test_native_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id AS int))").alias("ts")) \
        .write.parquet(path)
    df = spark.read.parquet(path)
    rule = FilterRule("id", "greater_equal", "90")
    plan = df.filter(matches(df, rule)).filter(matches(df, FilterRule("ts", "less", "2024-04-03")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,90)" in text and "LessThan(ts" in text
    assert plan.count() == 3


def test_category_rule_is_case_insensitive(spark):
    df = text_frame(spark, ["s"], [[" delivered "], ["DELIVERED"], ["x"], [None], ["__null__"]])
    hit = [r[0] for r in df.select(matches_category(df, FilterRule("s", "equals", "Delivered"))).collect()]
    other = [r[0] for r in df.select(matches_category(df, FilterRule("s", "not_equals", "delivered"))).collect()]
    assert hit == [True, True, False, False, False] and other == [False, False, True, False, False]
    with pytest.raises(ValueError):
        matches_category(df, FilterRule("s", "greater", "a"))


def test_incomplete_rules_are_refused(spark):
    df = text_frame(spark, ["a"], [["1"]])
    for rule in (FilterRule("a", "equals", " "), FilterRule("", "equals", "1"), FilterRule("a", "like", "1"),
                 FilterRule("b", "equals", "1")):
        with pytest.raises(ValueError):
            matches(df, rule)
    assert df.filter(matches(df, FilterRule("", "equals", "", enabled=False))).count() == 1


def test_no_digit_of_a_double_is_rounded(spark):
    pairs = [(1.23456784e-11, 1.23456781e-11), (1.2345678901234561e-4, 1.2345678901234564e-4), (1.00000000001e-8, 1.00000000002e-8), (-1.00000000001e-8, -1.00000000002e-8)]
    df = spark.createDataFrame([(v,) for pair in pairs for v in pair], "v double")
    shown = [r[0] for r in df.select(cells.raw_text(df, "v")).collect()]
    assert shown[:2] == ["0.0000000000123456784", "0.0000000000123456781"]
    assert shown == [f"{Decimal(repr(v)):f}" for pair in pairs for v in pair]
    assert df.select(cells.row_digest(df)).distinct().count() == df.count() == cleaning.keep_first(df).count()


def test_plain_form_of_doubles_keeps_their_value(spark):
    rng = random.Random(8)
    values = [rng.choice((-1, 1)) * rng.uniform(1, 9.9) * 10.0 ** rng.randint(-307, 307) for _ in range(3000)] + [1.23e-13, 1.5e18, 5e-324, 1.7976931348623157e308, 1e-12, 1e18, 1e15, 12345678.9, 1e7, 1.5e-3, 1e-4, 123456789012345680.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, text in df.select("v", cells.raw_text(df, "v")).collect():
        assert float(text) == v and "E" not in text and not (("." in text) and text.endswith("0")), (v, text)
