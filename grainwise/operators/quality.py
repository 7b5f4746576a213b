"""Data-quality findings as rows: duplicates, keys, completeness, validity, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.operators import order_stats
from grainwise.operators.metrics import check_rows
from grainwise.operators.profile import column_stats, looks_like_date, looks_like_identifier
from grainwise.session import settled

# Fixed values.
MINIMUM_VALUES = 8  # fewer numeric values than this and the outlier check is skipped
FENCE = 1.5
CHECKS = ("duplicate_rows", "key_grain", "completeness", "validity", "outlier")

ISSUE = "issue_id string, check string, severity string, field string, affected bigint, share double, repair string"


def _issue(issue_id: Column, check: str, severity: Column, field: Column, affected: Column, share: Column,
           repair: str | None) -> list[Column]:
    return [
        issue_id.alias("issue_id"), F.lit(check).alias("check"), severity.alias("severity"),
        field.cast("string").alias("field"), affected.cast("bigint").alias("affected"),
        share.alias("share"), F.lit(repair).cast("string").alias("repair"),
    ]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: groups of identical rows, surplus copies, their share of the table."""
    copies = df.select(cells.row_digest(df).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    ).withColumn("share", cells.safe_divide(F.col("surplus_rows"), F.col("rows")))


def identifier_duplicates(df: DataFrame, ids: list[str]) -> DataFrame:
    """Per identifier column: repeated values and the rows that carry them.

    Values are compared trimmed and without case. Counts are combined per value
    on the map side, so a value on a third of all rows costs one row per task.
    """
    df = cells.normalised(df, ids)
    pairs = [F.struct(F.lit(n).alias("column"), F.lower(cells.text(df, n)).alias("value")) for n in ids]
    return (
        df.select(F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column").agg(
            F.count_if(F.col("n") > 1).alias("repeated_values"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("affected_rows"),
        )
    )


def missing_issues(stats: DataFrame, ids: list[str]) -> DataFrame:
    rate = F.col("missing_rate")
    severity = (
        F.when(F.col("column").isin(ids) | (rate >= 0.2), F.lit("high"))
        .when(rate >= 0.05, F.lit("medium")).otherwise(F.lit("low"))
    )
    return stats.filter(F.col("missing") > 0).select(*_issue(
        F.concat(F.lit("missing-"), F.col("position").cast("string")), "completeness", severity, F.col("column"),
        F.col("missing"), rate, "drop_missing",
    ))


def invalid_date_issues(stats: DataFrame, dates: list[str]) -> DataFrame:
    bad = F.col("present") - F.col("date_cells")
    share = cells.safe_divide(bad, F.col("present"))
    severity = F.when(share >= 0.05, F.lit("high")).otherwise(F.lit("medium"))
    return stats.filter(F.col("column").isin(dates) & (bad > 0)).select(*_issue(
        F.concat(F.lit("invalid-date-"), F.col("position").cast("string")), "validity", severity, F.col("column"),
        bad, share, "drop_invalid_date",
    ))


def mixed_type_issues(stats: DataFrame, dates: list[str]) -> DataFrame:
    undated = ~(F.col("column").isin(dates) & (F.col("present") > 0))
    return stats.filter(undated & (F.col("inferred_type") == "mixed")).select(*_issue(
        F.concat(F.lit("mixed-type-"), F.col("position").cast("string")), "validity", F.lit("medium"), F.col("column"),
        F.col("present"), F.lit(1.0), None,
    ))


def outlier_bounds(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """{column: quartiles and fences} for columns with enough numeric values.

    Quartiles are exact (linear interpolation) and come back as a few numbers
    per column; see ``order_stats`` for how they are found without a gather.
    """
    numbers = df.select(*[cells.number(df, n).alias(n) for n in names])
    bounds = {}
    for name, (n, quarters) in order_stats.quantiles(numbers, names, [0.25, 0.75]).items():
        if n >= MINIMUM_VALUES:
            q1, q3 = quarters
            bounds[name] = {"values": n, "q1": q1, "q3": q3,
                            "low": q1 - FENCE * (q3 - q1), "high": q3 + FENCE * (q3 - q1)}
    return bounds


def outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """Per numeric column: values, quartiles, fences and how many values lie outside.

    The fences are literals, so the count is one scan with a conditional
    aggregate and no join.
    """
    bounds = outlier_bounds(df, names)
    order = [n for n in names if n in bounds]
    schema = "column string, values bigint, q1 double, q3 double, low double, high double, outliers bigint"
    if not order:
        return df.sparkSession.createDataFrame([], schema)
    counted = df.agg(*[
        F.count_if(~cells.number(df, n).between(bounds[n]["low"], bounds[n]["high"])).alias(f"o{i}")
        for i, n in enumerate(order)
    ])
    rows = [
        F.struct(
            F.lit(n).alias("column"), F.lit(bounds[n]["values"]).cast("bigint").alias("values"),
            *[F.lit(float(bounds[n][k])).alias(k) for k in ("q1", "q3", "low", "high")],
            F.col(f"o{i}").alias("outliers"),
        )
        for i, n in enumerate(order)
    ]
    return counted.select(F.inline(F.array(*rows)))


def numeric_columns(stats: DataFrame, ids: list[str]) -> DataFrame:
    """Columns the outlier check applies to."""
    return stats.filter((F.col("inferred_type") == "number") & ~F.col("column").isin(ids))


def skipped_checks(stats: DataFrame, ids: list[str]) -> DataFrame:
    """Checks that did not run, and why; a skipped check is not a passed one."""
    return numeric_columns(stats, ids).filter(F.col("present") < MINIMUM_VALUES).select(
        F.lit("outlier").alias("check"), F.col("column").alias("field"), F.col("present").alias("valid_values"),
        F.concat(F.lit("needs "), F.lit(str(MINIMUM_VALUES)), F.lit(" values, has "),
                 F.col("present").cast("string")).alias("reason"),
    )


def resolve_roles(
    df: DataFrame, names: list[str], ids: list[str] | None, dates: list[str] | None
) -> tuple[list[str], list[str]]:
    """Identifier and date columns: named ones, or those whose name reads as one."""
    ids = [n for n in names if looks_like_identifier(n)] if ids is None else ids
    dates = [n for n in names if looks_like_date(n)] if dates is None else dates
    cells.require(df, [*ids, *dates])
    return ids, dates


def issues(
    df: DataFrame,
    names: list[str] | None = None,
    ids: list[str] | None = None,
    dates: list[str] | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """All findings on a table, one row each.

    Three scans: one for the column counters, one that shuffles row digests,
    one that shuffles identifier values; plus the quartile passes. The counters
    (one row per column) are read back once, because they tell which columns are
    numeric, and reused from there.
    """
    names = names or df.columns
    ids, dates = resolve_roles(df, names, ids, dates)
    stats = column_stats(df, names) if stats is None else stats
    stats = settled(stats)
    duplicates = duplicate_rows(df.select(*[cells.col(n) for n in names])).filter("surplus_rows > 0").select(*_issue(
        F.lit("duplicate-rows"), "duplicate_rows", F.lit("high"), F.lit(None), F.col("surplus_rows"), F.col("share"),
        "deduplicate_exact",
    ))
    found = [duplicates, missing_issues(stats, ids), invalid_date_issues(stats, dates), mixed_type_issues(stats, dates)]
    if ids:
        repeated = identifier_duplicates(df, ids).filter("affected_rows > 0")
        # one row per identifier column joined to one row per column
        keyed = repeated.join(F.broadcast(stats), "column").select(*_issue(
            F.concat(F.lit("identifier-duplicates-"), F.col("position").cast("string")), "key_grain",
            F.when(F.col("missing") > 0, F.lit("high")).otherwise(F.lit("medium")), F.col("column"),
            F.col("affected_rows"), cells.safe_divide(F.col("affected_rows"), F.col("rows")), None,
        ))
        found.append(keyed)
    numeric = [r["column"] for r in numeric_columns(stats, ids).select("column").collect()]
    if numeric:
        extreme = outliers(df, numeric).filter("outliers > 0")
        place = F.coalesce(*[F.when(F.col("column") == n, F.lit(str(names.index(n)))) for n in numeric])
        found.append(extreme.select(*_issue(
            F.concat(F.lit("outlier-"), place), "outlier", F.lit("medium"), F.col("column"),
            F.col("outliers"), cells.safe_divide(F.col("outliers"), F.col("values")), None,
        )))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def summary(found: DataFrame, stats: DataFrame, ids: list[str]) -> DataFrame:
    """Checks run and passed, and findings by severity, one row.

    The outlier check counts as run only when some numeric column had enough values.
    """
    ran = numeric_columns(stats, ids).agg(
        F.count_if(F.col("present") >= MINIMUM_VALUES).alias("n")
    ).select((F.lit(4) + F.when(F.col("n") > 0, F.lit(1)).otherwise(F.lit(0))).cast("bigint")).scalar()
    # five check names at most, so the set is bounded
    return found.agg(
        ran.alias("checks_run"),
        F.count_distinct("check").alias("failed_checks"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
        F.count_if(F.col("severity") == "low").alias("low"),
    ).select(
        "checks_run", F.greatest(F.lit(0), F.col("checks_run") - F.col("failed_checks")).alias("passed_checks"),
        "high", "medium", "low",
    )


def decision_rollup(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counts of findings by what was decided; ``decisions`` is (issue_id, decision)."""
    choice, repairable = F.col("decision"), F.col("repair").isNotNull()
    return found.join(decisions.select("issue_id", "decision"), "issue_id", "left").agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if((choice == "approved") & repairable).alias("approved_repairs"),
        F.count_if((choice == "approved") & ~repairable).alias("reviewed"),
        F.count_if(choice == "kept").alias("kept"),
        F.count_if(choice.isNull()).alias("undecided"),
    )


def execution_gate(rollup: DataFrame, repairs_applied: bool) -> DataFrame:
    """May calculation start? Not while a finding is undecided or an approved repair is open."""
    open_repair = (F.col("approved_repairs") > 0) & ~F.lit(repairs_applied)
    return rollup.select(
        "undecided", open_repair.alias("repair_pending"),
        ((F.col("undecided") == 0) & ~open_repair).alias("ready"),
    )


def gate_checks(gate: DataFrame) -> DataFrame:
    return check_rows(gate, [("all_decided", F.col("undecided") == 0), ("repairs_applied", ~F.col("repair_pending"))])
