"""Every released number is computed twice.

Path A is the DataFrame implementation. Path B is Spark SQL text over the
normalised text table: other expressions, other aggregation shape, operands as
bound parameters. Both are compared in Spark; only the verdict reaches the
driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.functions.predicates import FilterRule, operand_moment, operand_number
from grainwise.operators import grouped, metrics
from grainwise.operators.grouped import Analysis
from grainwise.operators.metrics import Metric
from grainwise.operators.profile import fingerprint, version_changes

TOLERANCE = 1e-9


def text_table(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every cell as trimmed text or NULL: the common input of the second path."""
    return df.select(*[cells.text(df, n).alias(n) for n in names or df.columns])


def close(a: Column, b: Column) -> Column:
    """Equal within a relative tolerance; NULL only equals NULL."""
    a, b = a.cast("double"), b.cast("double")
    margin = F.greatest(F.lit(TOLERANCE), F.abs(a) * TOLERANCE, F.abs(b) * TOLERANCE)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= margin)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number_sql(name: str) -> str:
    return (f"CASE WHEN regexp_like({name}, r'^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$') "
            f"THEN try_cast({name} AS DOUBLE) END")


COMPARISON = {"equals": "=", "not_equals": "<>", "greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<="}


def rule_sql(rule: FilterRule | None, prefix: str) -> tuple[str, dict]:
    """(SQL condition, bound operands) of a filter rule over the text table."""
    if rule is None or not rule.enabled:
        return "TRUE", {}
    name, text = quoted(rule.field), f"{prefix}_text"
    if rule.operator == "not_empty":
        return f"{name} IS NOT NULL", {}
    if rule.operator == "contains":
        return f"coalesce(instr(lower({name}), lower(:{text})) > 0, FALSE)", {text: rule.value}
    sign = COMPARISON[rule.operator]
    plain = f"lower({name}) {sign} lower(:{text})"
    args: dict = {text: rule.value.strip()}
    target, moment = operand_number(rule.value), operand_moment(rule.value)
    if target is not None:
        args[f"{prefix}_number"] = target
        cast = (f"CASE WHEN regexp_like({name}, r'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') "
                f"THEN try_cast({name} AS DOUBLE) END")
        return f"coalesce(if({cast} IS NOT NULL, {cast} {sign} :{prefix}_number, {plain}), FALSE)", args
    if moment is not None:
        args[f"{prefix}_moment"] = moment.isoformat(sep=" ")
        cast = f"try_cast(replace({name}, '/', '-') AS TIMESTAMP_NTZ)"
        aim = f"CAST(:{prefix}_moment AS TIMESTAMP_NTZ)"
        return f"coalesce(if({cast} IS NOT NULL, {cast} {sign} {aim}, {plain}), FALSE)", args
    return f"coalesce({plain}, FALSE)", args


def metric_sql(metric: Metric) -> tuple[str, dict]:
    """Second-path statement of a metric over {data}, with its parameters."""
    scope, scope_args = rule_sql(metric.scope, "scope")
    hit, hit_args = rule_sql(metric.numerator, "hit") if metric.kind == "ratio" else ("FALSE", {})
    number = _number_sql(quoted(metric.value)) if metric.kind in ("amount", "average") else "CAST(NULL AS DOUBLE)"
    value = {
        "count": "CAST(count(DISTINCT entity) AS DOUBLE)",
        "amount": "sum(number)",
        "average": "sum(number) / nullif(count(DISTINCT CASE WHEN number IS NOT NULL THEN entity END), 0)",
        "ratio": "CAST(count(DISTINCT CASE WHEN hit THEN entity END) AS DOUBLE) / nullif(count(DISTINCT entity), 0)",
    }[metric.kind]
    invalid = "count_if(number IS NULL)" if metric.kind in ("amount", "average") else "0"
    pair = ("count(DISTINCT CASE WHEN hit THEN entity END)", "count(DISTINCT entity)") if metric.kind == "ratio" else (
        "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)")
    return (
        f"""
        WITH base AS (
          SELECT {quoted(metric.entity)} AS entity, {number} AS number, {hit} AS hit
          FROM {{data}} WHERE {scope}
        )
        SELECT {value} AS value,
               (SELECT count(*) FROM {{data}}) AS source_rows,
               count(*) AS eligible_rows,
               count(DISTINCT entity) AS distinct_entities,
               count_if(entity IS NULL) AS missing_entity_rows,
               {invalid} AS invalid_value_rows,
               {pair[0]} AS numerator,
               {pair[1]} AS denominator
        FROM base
        """,
        {**scope_args, **hit_args},
    )


BUCKET_SQL = {
    "day": "date_format({d}, 'yyyy-MM-dd')",
    "week": "concat(extract(YEAROFWEEK FROM {d}), '-W', lpad(CAST(weekofyear({d}) AS STRING), 2, '0'))",
    "month": "date_format({d}, 'yyyy-MM')",
    "quarter": "concat(CAST(year({d}) AS STRING), '-Q', CAST(quarter({d}) AS STRING))",
}


def _category_sql(rule: FilterRule | None, prefix: str) -> tuple[str, dict]:
    if rule is None or not rule.enabled:
        return "TRUE", {}
    if rule.operator == "not_empty":
        return f"{quoted(rule.field)} IS NOT NULL", {}
    condition = f"lower({quoted(rule.field)}) {COMPARISON[rule.operator]} lower(:{prefix})"
    return f"coalesce({condition}, FALSE)", {prefix: rule.value.strip()}


def analysis_sql(analysis: Analysis) -> tuple[str, dict]:
    """Second-path statement of a grouped analysis over {data}: every group, uncut."""
    ratio, measured = analysis.aggregation == "ratio", analysis.aggregation in ("sum", "average")
    scope, scope_args = _category_sql(analysis.denominator, "scope") if ratio else ("TRUE", {})
    hit, hit_args = _category_sql(analysis.numerator, "hit") if ratio else ("FALSE", {})
    if analysis.shape == "trend":
        name = quoted(analysis.time)
        parsed = (f"CASE WHEN regexp_like({name}, r'^[0-9]{{{{4}}}}[-/][0-9]{{{{1,2}}}}[-/][0-9]{{{{1,2}}}}([ T].*)?$') "
                  f"THEN try_cast(replace({name}, '/', '-') AS TIMESTAMP) END")
        key = BUCKET_SQL[analysis.grain].format(d=parsed)
    else:
        key = quoted(analysis.group)
    number = _number_sql(quoted(analysis.value)) if measured else "CAST(NULL AS DOUBLE)"
    valid = "number IS NOT NULL AND entity IS NOT NULL" if analysis.aggregation == "average" else "number IS NOT NULL"
    value = {
        "count_distinct": "CAST(count(DISTINCT entity) AS DOUBLE)",
        "sum": "sum(number)",
        "average": "sum(CASE WHEN entity IS NOT NULL THEN number END)"
                   " / nullif(count(DISTINCT CASE WHEN number IS NOT NULL THEN entity END), 0)",
        "ratio": "CAST(count(DISTINCT CASE WHEN hit THEN entity END) AS DOUBLE) / nullif(count(DISTINCT entity), 0)",
    }[analysis.aggregation]
    hits = "count(DISTINCT CASE WHEN hit THEN entity END)" if ratio else "CAST(NULL AS BIGINT)"
    base = "count(DISTINCT entity)" if ratio else "CAST(NULL AS BIGINT)"
    return (
        f"""
        WITH base AS (
          SELECT {scope} AS in_scope, {key} AS key, {quoted(analysis.entity)} AS entity,
                 {number} AS number, {hit} AS hit
          FROM {{data}}
        )
        SELECT in_scope, key, {value} AS value, count(*) AS source_rows,
               count(DISTINCT entity) AS distinct_entities,
               count_if(entity IS NULL) AS missing_entity_rows,
               {f"count_if(NOT ({valid}))" if measured else "0"} AS invalid_value_rows,
               {hits} AS numerator, {base} AS denominator
        FROM base GROUP BY in_scope, key
        """.replace("{{{{", "{{").replace("}}}}", "}}"),
        {**scope_args, **hit_args},
    )


def run_sql(df: DataFrame, statement: str, args: dict) -> DataFrame:
    return df.sparkSession.sql(statement, args=args or None, data=df)


def _long(row: DataFrame, names: list[str], label: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias(label)) for n in names]
    return row.select(F.inline(F.array(*pairs)))


MEASURES = [
    "value", "source_rows", "eligible_rows", "distinct_entities", "missing_entity_rows", "invalid_value_rows",
    "numerator", "denominator",
]


def verify_metric(df: DataFrame, metric: Metric, primary: DataFrame | None = None) -> DataFrame:
    """(measure, primary, reference, passed): both paths of one metric."""
    primary = metrics.evaluate(df, metric) if primary is None else primary
    reference = run_sql(text_table(df, metric.fields()), *metric_sql(metric))
    pair = _long(primary, MEASURES, "primary").join(_long(reference, MEASURES, "reference"), "measure")
    return pair.withColumn("passed", close(F.col("primary"), F.col("reference")))


def verify_groups(df: DataFrame, analysis: Analysis, primary: DataFrame | None = None) -> DataFrame:
    """(check, compared, mismatches, passed): every group of both paths, then the totals.

    The join is null-safe on the key, so excluded rows (NULL key) are compared
    too, and it happens before any cut: a wrong group cannot hide below top N.
    """
    primary = grouped.per_group(df, analysis) if primary is None else primary
    reference = run_sql(text_table(df, analysis.fields()), *analysis_sql(analysis))
    a, b = primary.alias("a"), reference.alias("b")
    same = F.col("a.in_scope").eqNullSafe(F.col("b.in_scope")) & F.col("a.key").eqNullSafe(F.col("b.key"))
    both = a.join(b, same, "full_outer")
    present = F.col("a.source_rows").isNotNull() & F.col("b.source_rows").isNotNull()
    tests = {
        "groups_agree": present,
        "values_agree": close(F.col("a.value"), F.col("b.value")),
        "rows_agree": close(F.col("a.source_rows"), F.col("b.source_rows")),
        "entities_agree": close(F.col("a.distinct_entities"), F.col("b.distinct_entities")),
        "exclusions_agree": close(F.col("a.missing_entity_rows"), F.col("b.missing_entity_rows"))
        & close(F.col("a.invalid_value_rows"), F.col("b.invalid_value_rows")),
        "ratio_parts_agree": close(F.col("a.numerator"), F.col("b.numerator"))
        & close(F.col("a.denominator"), F.col("b.denominator")),
    }
    counted = both.agg(
        F.count(F.lit(1)).alias("compared"),
        *[F.count_if(~(present & test)).alias(name) for name, test in tests.items()],
    )
    rows = [F.struct(F.lit(n).alias("check"), F.col("compared"), F.col(n).alias("mismatches")) for n in tests]
    return counted.select(F.inline(F.array(*rows))).withColumn(
        "passed", (F.col("compared") > 0) & (F.col("mismatches") == 0)
    )


def verdict(checks: DataFrame) -> DataFrame:
    """One row: passed only if there was at least one check and all of them passed."""
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.coalesce(F.col("passed"), F.lit(False))).alias("failed"),
    ).withColumn("passed", (F.col("checks") > 0) & (F.col("failed") == 0))


class VerificationFailed(RuntimeError):
    """The two computations disagree; the result must not be released."""


def release(result: DataFrame, checks: DataFrame) -> DataFrame:
    """``result`` if its checks passed, an error otherwise."""
    row = verdict(checks).first()
    if not row["passed"]:
        raise VerificationFailed(f"{row['failed']} of {row['checks']} checks failed")
    return result


def table_parity(source: dict[str, DataFrame], restored: dict[str, DataFrame]) -> DataFrame:
    """Per table: do the restored copy's rows equal the source's, as counts and content?"""
    def versions(tables: dict[str, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [fingerprint(df, name) for name, df in sorted(tables.items())])
    return version_changes(versions(source), versions(restored))
