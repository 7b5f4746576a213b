"""Findings, their severity, their impact on a metric, the gate before calculation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions.predicates import FilterRule
from grainwise.operators import impact, quality
from grainwise.operators.grouped import Analysis
from grainwise.queries.base import CLEAN_CTE, DIRTY, DIRTY_SQL, Tables, cls, dirty_events, num, query, rounded, trim, txt

IDS = ["event_id", "customer_id"]
DATES = ["purchase_date"]


@query("quality_duplicate_rows", "Q1", f"""
    WITH copies AS (SELECT count(*) AS n FROM documents GROUP BY {trim('text')}, {trim('lang')})
    SELECT count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS surplus_rows,
      CAST(sum(n) AS BIGINT) AS rows, round(sum(n - 1) / sum(n), 4) AS share FROM copies
""")
def duplicate_rows(t: Tables) -> DataFrame:
    return rounded(quality.duplicate_rows(t.documents.select("text", "lang")))


@query("quality_identifier_dups", "Q2 N5", f"""
    WITH {CLEAN_CTE},
    long AS (
      SELECT 'customer_id' AS "column", lower(customer_id) AS v FROM cells WHERE customer_id IS NOT NULL
      UNION ALL SELECT 'event_id', CAST(event_id AS VARCHAR) FROM cells),
    counts AS (SELECT "column", v, count(*) AS n FROM long GROUP BY ALL)
    SELECT "column", count(*) FILTER (n > 1) AS repeated_values,
      CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS affected_rows FROM counts GROUP BY "column"
""")
def identifier_dups(t: Tables) -> DataFrame:
    return quality.identifier_duplicates(dirty_events(t), IDS)


def _stats_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", {i} AS position, "
        + (f"CASE WHEN {n} IS NOT NULL THEN 'number' END" if n == "event_id" else cls(n)) + " AS class FROM dirty"
        for i, n in enumerate(DIRTY)
    )
    return f"""dirty AS ({DIRTY_SQL}), long AS ({long}),
    stats AS (SELECT "column", position, count(*) AS rows, count(class) AS present, count(*) - count(class) AS missing,
      count(*) FILTER (class = 'date') AS dates,
      CASE WHEN count(class) = 0 THEN 'empty' WHEN count(DISTINCT class) = 1 THEN max(class) ELSE 'mixed' END AS kind
      FROM long GROUP BY ALL)"""


MISSING_SQL = """SELECT 'missing-' || position AS issue_id, 'completeness' AS "check",
    CASE WHEN "column" IN ('event_id', 'customer_id') OR missing / rows >= 0.2 THEN 'high'
         WHEN missing / rows >= 0.05 THEN 'medium' ELSE 'low' END AS severity,
    "column" AS field, missing AS affected, round(missing / rows, 4) AS share, 'drop_missing' AS repair
    FROM stats WHERE missing > 0"""
DATES_SQL = """SELECT 'invalid-date-' || position AS issue_id, 'validity' AS "check",
    CASE WHEN (present - dates) / present >= 0.05 THEN 'high' ELSE 'medium' END AS severity,
    "column" AS field, present - dates AS affected, round((present - dates) / present, 4) AS share,
    'drop_invalid_date' AS repair FROM stats WHERE "column" = 'purchase_date' AND present > dates"""
MIXED_SQL = """SELECT 'mixed-type-' || position AS issue_id, 'validity' AS "check", 'medium' AS severity,
    "column" AS field, present AS affected, 1.0::DOUBLE AS share, CAST(NULL AS VARCHAR) AS repair
    FROM stats WHERE kind = 'mixed' AND NOT ("column" = 'purchase_date' AND present > 0)"""


@query("quality_missing", "Q3", f"WITH {_stats_sql()} {MISSING_SQL}")
def missing(t: Tables) -> DataFrame:
    return rounded(quality.missing_issues(quality.column_stats(dirty_events(t)), IDS))


@query("quality_invalid_dates", "Q4", f"WITH {_stats_sql()} {DATES_SQL}")
def invalid_dates(t: Tables) -> DataFrame:
    return rounded(quality.invalid_date_issues(quality.column_stats(dirty_events(t)), DATES))


@query("quality_mixed_types", "Q5", f"WITH {_stats_sql()} {MIXED_SQL}")
def mixed_types(t: Tables) -> DataFrame:
    return rounded(quality.mixed_type_issues(quality.column_stats(dirty_events(t)), DATES))


def _outlier_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count(v) AS "values", round(max(q1), 6) AS q1, round(max(q3), 6) AS q3,
      round(max(q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(q3 + 1.5 * (q3 - q1)), 6) AS high,
      count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM (SELECT v, quantile_cont(v, 0.25) OVER () AS q1, quantile_cont(v, 0.75) OVER () AS q3 FROM ({source}))"""


@query("quality_iqr_outliers", "Q6", " UNION ALL ".join([
    _outlier_sql("l_extendedprice", "SELECT l_extendedprice AS v FROM lineitem"),
    _outlier_sql("l_quantity", "SELECT l_quantity AS v FROM lineitem"),
    _outlier_sql("amount", f"SELECT {num('amount')} AS v FROM ({DIRTY_SQL})"),
    _outlier_sql("n_chars", "SELECT n_chars AS v FROM documents"),
]))
def iqr_outliers(t: Tables) -> DataFrame:
    found = quality.outliers(t.lineitem, ["l_extendedprice", "l_quantity"])
    found = found.unionByName(quality.outliers(dirty_events(t), ["amount"]))
    return rounded(found.unionByName(quality.outliers(t.documents, ["n_chars"])), 6)


@query("quality_skips", "Q7", """
    WITH stats AS (
      SELECT 'r_regionkey' AS field, count(r_regionkey) AS n FROM region
      UNION ALL SELECT 'n_regionkey', count(n_regionkey) FROM nation)
    SELECT 'outlier' AS "check", field, n AS valid_values, 'needs 8 values, has ' || n AS reason FROM stats WHERE n < 8
""")
def skips(t: Tables) -> DataFrame:
    small = quality.skipped_checks(quality.column_stats(t.region), [])
    return small.unionByName(quality.skipped_checks(quality.column_stats(t.nation, ["n_regionkey"]), []))


COPIES = ", ".join(f"trim({c}, ' ')" for c in DIRTY if c != "event_id")
ISSUES_CTE = f"""{_stats_sql()},
    copies AS (SELECT count(*) AS n FROM dirty GROUP BY {COPIES}),
    idv AS (SELECT lower({txt('customer_id')}) AS v, count(*) AS n FROM dirty GROUP BY 1),
    found AS (
      SELECT 'duplicate-rows' AS issue_id, 'duplicate_rows' AS "check", 'high' AS severity, CAST(NULL AS VARCHAR) AS field,
        CAST(sum(n - 1) AS BIGINT) AS affected, round(sum(n - 1) / sum(n), 4) AS share, 'deduplicate_exact' AS repair
        FROM copies HAVING sum(n - 1) > 0
      UNION ALL ({MISSING_SQL}) UNION ALL ({DATES_SQL}) UNION ALL ({MIXED_SQL})
      UNION ALL SELECT 'identifier-duplicates-0', 'key_grain', 'high', 'customer_id',
        CAST(sum(n) FILTER (n > 1) AS BIGINT), round(sum(n) FILTER (n > 1) / (SELECT count(*) FROM dirty), 4), NULL
        FROM idv WHERE v IS NOT NULL)"""
# Without event_id the columns move up by one place.
ISSUES_SQL = ISSUES_CTE.replace("'missing-' || position", "'missing-' || (position - 1)").replace(
    "'invalid-date-' || position", "'invalid-date-' || (position - 1)").replace(
    "'mixed-type-' || position", "'mixed-type-' || (position - 1)").replace(
    "FROM stats WHERE missing > 0", "FROM stats WHERE missing > 0 AND \"column\" <> 'event_id'")


def _issues(t: Tables) -> DataFrame:
    return quality.issues(dirty_events(t).drop("event_id"), ids=["customer_id"], dates=DATES)


@query("quality_issues", "Q1 Q2 Q3 Q4 Q5", f"WITH {ISSUES_SQL} SELECT * FROM found")
def issues(t: Tables) -> DataFrame:
    return rounded(_issues(t))


@query("quality_summary", "Q8", f"""WITH {ISSUES_SQL}
    SELECT CAST(4 AS BIGINT) AS checks_run,
      greatest(0, 4 - count(DISTINCT "check")) AS passed_checks, count(*) FILTER (severity = 'high') AS high,
      count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM found""")
def summary(t: Tables) -> DataFrame:
    df = dirty_events(t).drop("event_id")
    return quality.summary(_issues(t), quality.column_stats(df), ["customer_id"])


COUNT = impact.MetricContext("orders", "count", "customer_id", time="purchase_date", question="how many customers")
AMOUNT = impact.MetricContext("amount total", "amount", "customer_id", "amount", "purchase_date", question="total amount")
MONTHLY = impact.MetricContext("monthly orders", "count", "customer_id", time="purchase_date", question="orders per month")
SHARE = impact.MetricContext("delivered share", "ratio", "customer_id", time="purchase_date",
                             extra_scope="status equals delivered", grain_confirmed=False)
CONTEXTS = [COUNT, AMOUNT, MONTHLY, SHARE]


def _impact_case(metric: str, measured: bool, timed: bool, scoped: list[str], confirmed: bool, scope_text: str) -> str:
    value = "f = 'amount'" if measured else "FALSE"
    hits = " OR ".join([f"(f <> '' AND contains('{scope_text}', f))"] + [f"f = '{s}'" for s in scoped])
    used = f"({hits})"
    time = "f = 'purchase_date'" if timed else "FALSE"
    dup = "('affecting', 'approved')" if measured else "('unrelated', 'kept')"
    key = "CASE WHEN f = 'customer_id' AND {ok} THEN ('unrelated', 'approved') WHEN f = 'customer_id' OR {used} OR {m} THEN " \
          "('review', 'manual_review') ELSE ('unrelated', 'kept') END"
    key = key.format(ok=str(not measured and confirmed).upper(), used=used, m=str(measured).upper())
    disclose, keep = "('affecting', 'manual_review')", "('unrelated', 'kept')"
    return f"""SELECT '{metric}' AS metric, issue_id, "check", field, CASE "check"
        WHEN 'duplicate_rows' THEN {dup} WHEN 'key_grain' THEN {key}
        WHEN 'completeness' THEN CASE WHEN f = 'customer_id' OR {value} OR {time} OR {used} THEN {disclose} ELSE {keep} END
        WHEN 'outlier' THEN CASE WHEN {value} THEN {disclose} ELSE {keep} END
        WHEN 'validity' THEN CASE WHEN {time} OR {used} OR {value} OR f = 'customer_id' THEN {disclose} ELSE {keep} END
        ELSE ('review', 'manual_review') END AS v
        FROM (SELECT *, lower(coalesce(field, '')) AS f FROM found)"""


IMPACT_CTE = ISSUES_SQL + ", judged AS (" + " UNION ALL ".join([
    _impact_case("orders", False, False, [], True, "how many customers"),
    _impact_case("amount total", True, False, [], True, "total amount"),
    _impact_case("monthly orders", False, True, [], True, "orders per month"),
    _impact_case("delivered share", False, False, ["status"], False, "status equals delivered"),
]) + ")"


@query("quality_impact", "Q9", f"""WITH {IMPACT_CTE}
    SELECT metric, issue_id, "check", field, v[1] AS level, v[2] AS recommended FROM judged""")
def quality_impact(t: Tables) -> DataFrame:
    return impact.assess_all(_issues(t), CONTEXTS)


@query("quality_impact_rollup", "Q10", f"""WITH {IMPACT_CTE}
    SELECT metric, count(*) FILTER (v[1] = 'affecting') AS affecting, count(*) FILTER (v[1] = 'review') AS review,
      count(*) FILTER (v[1] = 'unrelated') AS unrelated FROM judged GROUP BY metric""")
def impact_rollup(t: Tables) -> DataFrame:
    return impact.rollup(impact.assess_all(_issues(t), CONTEXTS))


@query("quality_review_grouped", "Q11", f"""WITH {ISSUES_SQL}, q AS (SELECT *, lower(coalesce(field, '')) AS f FROM found)
    SELECT 'delivered by region' AS metric, issue_id, "check", field,
      CASE WHEN "check" = 'duplicate_rows' THEN 'unrelated'
           WHEN "check" = 'key_grain' THEN 'review'
           WHEN "check" IN ('completeness', 'validity') AND f IN ('region', 'customer_id', 'status') THEN 'affecting'
           ELSE 'unrelated' END AS level,
      CASE WHEN "check" = 'duplicate_rows' THEN 'kept'
           WHEN "check" = 'key_grain' THEN 'manual_review'
           WHEN "check" IN ('completeness', 'validity') AND f IN ('region', 'customer_id', 'status') THEN 'manual_review'
           ELSE 'kept' END AS recommended FROM q
    UNION ALL SELECT 'no group yet', issue_id, "check", field, 'review', 'manual_review' FROM q""")
def review_grouped(t: Tables) -> DataFrame:
    found = _issues(t)
    hit = FilterRule("status", "equals", "delivered")
    ready = Analysis("group_compare", "ratio", "customer_id", group="region", numerator=hit)
    unfinished = Analysis("group_compare", "sum", "customer_id", group=None, value="amount")
    return impact.review_for(found, ready, "delivered by region").unionByName(
        impact.review_for(found, unfinished, "no group yet")
    )


DECIDED = """CASE WHEN "check" = 'duplicate_rows' THEN 'approved' WHEN "check" = 'key_grain' THEN 'approved'
    WHEN "check" = 'validity' THEN 'kept' END"""


def _decisions(found: DataFrame) -> DataFrame:
    choice = F.when(F.col("check").isin("duplicate_rows", "key_grain"), F.lit("approved")).when(
        F.col("check") == "validity", F.lit("kept"))
    return found.select("issue_id", choice.alias("decision")).filter(F.col("decision").isNotNull())


ROLLUP_CTE = ISSUES_SQL + f""", decided AS (SELECT *, {DECIDED} AS d FROM found),
    rollup AS (SELECT count(*) AS issues, count(*) FILTER (d = 'approved' AND repair IS NOT NULL) AS approved_repairs,
      count(*) FILTER (d = 'approved' AND repair IS NULL) AS reviewed, count(*) FILTER (d = 'kept') AS kept,
      count(*) FILTER (d IS NULL) AS undecided FROM decided)"""


@query("quality_decisions", "Q12", f"WITH {ROLLUP_CTE} SELECT * FROM rollup")
def decisions(t: Tables) -> DataFrame:
    found = _issues(t)
    return quality.decision_rollup(found, _decisions(found))


@query("quality_gate", "Q13", f"""WITH {ROLLUP_CTE}
    SELECT undecided, approved_repairs > 0 AS repair_pending, undecided = 0 AND approved_repairs = 0 AS ready FROM rollup""")
def gate(t: Tables) -> DataFrame:
    found = _issues(t)
    return quality.execution_gate(quality.decision_rollup(found, _decisions(found)), repairs_applied=False)
