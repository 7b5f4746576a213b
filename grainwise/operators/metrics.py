"""One number per table: distinct counts, guarded sums, per-entity averages, ratios.

Every metric is defined by *entity*: the business object that must be counted
once however many rows carry it. Instead of several ``countDistinct`` in one
aggregate (Spark would copy each row once per distinct set), rows are first
folded to one row per entity with map-side combining; all distinct counts are
then plain counts over that frame. One shuffle, keyed by entity, so a single
hot entity is combined before it travels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.functions.predicates import FilterRule, matched, matches

KINDS = ("count", "amount", "average", "ratio")


@dataclass(frozen=True)
class Metric:
    kind: str
    entity: str
    value: str | None = None
    scope: FilterRule | None = None
    numerator: FilterRule | None = None
    name: str = ""

    def check(self, df: DataFrame) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"metric kind must be one of {KINDS}, not {self.kind!r}")
        if self.kind in ("amount", "average") and not self.value:
            raise ValueError("a sum or an average needs a value field")
        if self.kind == "ratio" and (self.numerator is None or not self.numerator.enabled):
            raise ValueError("a ratio needs a numerator condition")
        cells.require(df, self.fields())

    def fields(self) -> list[str]:
        """The columns the metric reads."""
        rules = [self.scope, self.numerator if self.kind == "ratio" else None]
        names = [self.entity, self.value if self.kind in ("amount", "average") else None]
        names += [r.field for r in rules if r is not None and r.enabled]
        return list(dict.fromkeys(n for n in names if n))


def per_entity(df: DataFrame, metric: Metric) -> DataFrame:
    """One row per entity of the scope; the NULL entity holds entity-less rows."""
    df = cells.normalised(df, metric.fields())
    number = cells.number(df, metric.value) if metric.kind in ("amount", "average") else F.lit(None).cast("double")
    hit = matched(df, metric.numerator) if metric.kind == "ratio" else F.lit(False)
    scoped = df.filter(matches(df, metric.scope)) if metric.scope and metric.scope.enabled else df
    return (
        scoped.select(cells.identity(df, metric.entity).alias("entity"), number.alias("number"), hit.alias("hit"))
        .groupBy("entity")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("number").alias("valid_rows"),
            F.sum("number").alias("total"),
            F.max("hit").alias("hit"),
        )
    )


def evaluate(df: DataFrame, metric: Metric, source_rows: int | Column | None = None) -> DataFrame:
    """One row: the value and the accounting of every row that did or did not count.

    ``value`` is NULL, never zero, when nothing was measurable. In a sum and in
    the plain average, rows without an entity still add to the total.
    """
    metric.check(df)
    known = F.col("entity").isNotNull()
    value = {
        "count": F.count("entity").cast("double"),
        "amount": F.sum("total"),
        "average": cells.safe_divide(F.sum("total"), F.count_if(known & (F.col("valid_rows") > 0))),
        "ratio": cells.safe_divide(F.count_if(known & F.col("hit")), F.count("entity")),
    }[metric.kind]
    ratio = metric.kind == "ratio"
    measured = metric.kind in ("amount", "average")
    nothing = F.lit(None).cast("bigint")
    if source_rows is None:
        scoped = metric.scope is not None and metric.scope.enabled
        total = df.agg(F.count(F.lit(1))).scalar() if scoped else F.coalesce(F.sum("rows"), F.lit(0))
    else:
        total = F.lit(source_rows) if isinstance(source_rows, int) else source_rows
    return per_entity(df, metric).agg(
        value.alias("value"),
        total.cast("bigint").alias("source_rows"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("eligible_rows"),
        F.count("entity").alias("distinct_entities"),
        F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("missing_entity_rows"),
        (F.coalesce(F.sum(F.col("rows") - F.col("valid_rows")), F.lit(0)) if measured else F.lit(0).cast("bigint"))
        .alias("invalid_value_rows"),
        (F.count_if(known & F.col("hit")) if ratio else nothing).alias("numerator"),
        (F.count("entity") if ratio else nothing).alias("denominator"),
    )


def result_checks(result: DataFrame, metric: Metric, bound_rows: int | None = None) -> DataFrame:
    """Check rows on an ``evaluate`` result: scope, entity, finite value, ratio bounds."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    expected = F.lit(bound_rows).cast("bigint") if bound_rows is not None else F.col("source_rows")
    checks = [
        ("scope_unchanged", F.col("source_rows") == expected),
        ("entity_present", F.col("distinct_entities") > 0),
        ("value_finite", finite),
    ]
    if metric.kind == "ratio":
        checks.append(("ratio_bounds", finite & v.between(0, 1) & (F.col("numerator") <= F.col("denominator"))))
    return check_rows(result, checks)


def check_rows(row: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(check, passed) rows out of a one-row frame; an unknown outcome fails."""
    structs = [
        F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"))
        for name, passed in checks
    ]
    return row.select(F.inline(F.array(*structs)))


def display(value: Column, kind: str) -> Column:
    """Two decimals; a ratio as a percentage; text when there is no value."""
    if kind == "ratio":
        shown = F.concat(F.format_number(value * 100, 2), F.lit("%"))
    else:
        shown = F.call_function("format_number", F.round(value, 2), F.lit("#,##0.##"))
    return F.coalesce(shown, F.lit("not computable"))


@dataclass(frozen=True)
class Binding:
    """The table version a metric was confirmed on."""

    rows: int
    fields: tuple[str, ...] = field(default_factory=tuple)
    fingerprint: str | None = None


def drift_checks(df: DataFrame, binding: Binding, fingerprint: DataFrame | None = None) -> DataFrame:
    """Has the table moved away from what the metric was confirmed on?"""
    absent = sorted(set(binding.fields) - set(df.columns))
    checks = [
        ("row_count_unchanged", F.col("rows") == F.lit(binding.rows)),
        ("fields_present", F.lit(not absent)),
    ]
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    if binding.fingerprint is not None and fingerprint is not None:
        rows = fingerprint.select("rows", "fingerprint")
        checks.append(("content_unchanged", F.col("fingerprint") == F.lit(binding.fingerprint)))
    return check_rows(rows, checks)


# Display names that promise a quantity, and the words that make it a rate
# (fixed values).
QUANTITY_NAME = "订单(?:量|数量|数)|客户(?:数量|数)|用户(?:数量|数)|商品(?:数量|数)"
RATE_NAME = "率|比例|占比"


def name_conflict(name: Column, kind: Column) -> Column:
    """A name that promises a quantity must not label a sum, average or ratio."""
    return name.rlike(QUANTITY_NAME) & ~name.rlike(RATE_NAME) & (kind != "count")
