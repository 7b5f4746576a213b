"""Which findings matter to a given metric: affecting, review or unrelated."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.operators.grouped import Analysis

# Words that make a metric depend on time (fixed value).
TIME_WORDS = r"按(?:日|周|月|季|年)|趋势|环比|同比|周期|日期|时间|day|week|month|quarter|year|date|time"


@dataclass(frozen=True)
class MetricContext:
    name: str
    kind: str  # count, amount, average, ratio
    entity: str
    value: str | None = None
    time: str | None = None
    scope: str = ""
    question: str = ""
    extra_scope: str = ""
    groups: tuple[str, ...] = ()
    grain_confirmed: bool = True

    @property
    def distinct(self) -> bool:
        return self.kind in ("count", "ratio")

    @property
    def uses_time(self) -> bool:
        wording = " ".join((self.name, self.question, self.scope, self.extra_scope))
        return re.search(TIME_WORDS, wording, re.I) is not None


def _same(field: Column, name: str | None) -> Column:
    return (field == F.lit(name.strip().lower())) if name else F.lit(False)


def _verdict(level: str, decision: str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(decision).alias("decision"))


KEEP = ("unrelated", "kept")
SETTLED = ("unrelated", "approved")
REPAIR = ("affecting", "approved")
DISCLOSE = ("affecting", "manual_review")
REVIEW = ("review", "manual_review")


def assess(found: DataFrame, context: MetricContext) -> DataFrame:
    """Each finding with its level and recommended decision for one metric.

    The context is configuration, so the rules become one CASE expression over
    the findings; no join.
    """
    field = F.lower(F.trim(F.coalesce(F.col("field"), F.lit(""))))
    named = field != ""
    wording = " ".join((context.scope, context.question, context.extra_scope)).strip().lower()
    is_entity = named & _same(field, context.entity)
    is_value = named & _same(field, context.value)
    is_time = named & _same(field, context.time)
    is_group = named & reduce(lambda a, b: a | b, [_same(field, g) for g in context.groups], F.lit(False))
    in_scope = named & F.contains(F.lit(wording), field)
    timed = is_time & F.lit(context.uses_time)
    distinct = context.distinct

    rules: dict[str, list[tuple[Column, tuple[str, str]]]] = {
        "duplicate_rows": [(F.lit(distinct), KEEP), (F.lit(True), REPAIR)],
        "key_grain": [
            (is_entity & F.lit(distinct and context.grain_confirmed), SETTLED),
            (is_entity | in_scope | F.lit(not distinct), REVIEW),
            (F.lit(True), KEEP),
        ],
        "completeness": [
            (is_group | is_entity | (is_value & F.lit(not distinct)) | timed | in_scope, DISCLOSE),
            (F.lit(True), KEEP),
        ],
        "outlier": [(is_value & F.lit(not distinct), DISCLOSE), (F.lit(True), KEEP)],
        "validity": [(timed | in_scope | is_value | is_entity, DISCLOSE), (F.lit(True), KEEP)],
    }
    verdict = F.when(F.lit(False), _verdict(*REVIEW))
    for check, cases in rules.items():
        for condition, outcome in cases:
            verdict = verdict.when((F.col("check") == check) & condition, _verdict(*outcome))
    verdict = verdict.otherwise(_verdict(*REVIEW))
    return found.withColumn("v", verdict).select(
        F.lit(context.name).alias("metric"), "issue_id", "check", "field",
        F.col("v.level").alias("level"), F.col("v.decision").alias("recommended"),
    )


def assess_all(found: DataFrame, contexts: list[MetricContext]) -> DataFrame:
    return reduce(DataFrame.unionByName, [assess(found, c) for c in contexts])


def rollup(assessed: DataFrame) -> DataFrame:
    """Findings per metric and level, one row per metric."""
    level = F.col("level")
    return assessed.groupBy("metric").agg(
        F.count_if(level == "affecting").alias("affecting"),
        F.count_if(level == "review").alias("review"),
        F.count_if(level == "unrelated").alias("unrelated"),
    )


def context_of(analysis: Analysis, question: str, confirmed: bool = False) -> MetricContext | None:
    """Context of a grouped analysis, or None while its fields are incomplete."""
    trend = analysis.shape == "trend"
    measured = analysis.aggregation in ("sum", "average")
    ratio = analysis.aggregation == "ratio"
    key = analysis.time if trend else analysis.group
    complete = (
        bool(analysis.entity) and bool(key)
        and (not measured or bool(analysis.value))
        and (not ratio or (analysis.numerator is not None and bool(analysis.numerator.field)))
    )
    if not complete:
        return None
    extra = [key]
    if ratio:
        extra += [r.field for r in (analysis.numerator, analysis.denominator) if r is not None and r.enabled]
    kinds = {"count_distinct": "count", "sum": "amount", "average": "average", "ratio": "ratio"}
    return MetricContext(
        name=question, question=question, kind=kinds[analysis.aggregation], entity=analysis.entity,
        value=analysis.value if measured else None, time=analysis.time if trend else None,
        extra_scope=" ".join(extra), groups=() if trend else (analysis.group,), grain_confirmed=confirmed,
    )


def review_for(found: DataFrame, analysis: Analysis, question: str, confirmed: bool = False) -> DataFrame:
    """Impact on a grouped analysis; while its fields are open, everything needs review."""
    context = context_of(analysis, question, confirmed)
    if context is not None:
        return assess(found, context)
    return found.select(
        F.lit(question).alias("metric"), "issue_id", "check", "field",
        F.lit("review").alias("level"), F.lit("manual_review").alias("recommended"),
    )
