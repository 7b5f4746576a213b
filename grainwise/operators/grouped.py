"""Group comparison, trend and top-N with full row accounting.

Two aggregation levels: (group, entity), then group. The first one spreads a
hot group over all its entities and folds repeated rows of an entity on the
map side; the second sees one row per entity and combines again before its
shuffle, so no task ever holds a whole group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from grainwise.functions import cells
from grainwise.functions.predicates import FilterRule, matches_category
from grainwise.operators.metrics import check_rows

SHAPES = ("group_compare", "trend", "top_n")
AGGREGATIONS = ("count_distinct", "sum", "average", "ratio")
MOST_GROUPS_SHOWN = 50  # the largest N a ranking may ask for


@dataclass(frozen=True)
class Analysis:
    shape: str
    aggregation: str
    entity: str
    group: str | None = None
    time: str | None = None
    grain: str = "month"
    value: str | None = None
    limit: int = 5
    descending: bool = True
    numerator: FilterRule | None = None
    denominator: FilterRule | None = None

    def check(self, df: DataFrame) -> None:
        if self.shape not in SHAPES or self.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown analysis {self.shape}/{self.aggregation}")
        if self.shape == "trend" and not self.time:
            raise ValueError("a trend needs a time field")
        if self.shape != "trend" and not self.group:
            raise ValueError("a group comparison needs a group field")
        if self.aggregation in ("sum", "average") and not self.value:
            raise ValueError("a sum or an average needs a value field")
        if self.shape == "top_n" and not 1 <= self.limit <= MOST_GROUPS_SHOWN:
            raise ValueError(f"N must be between 1 and {MOST_GROUPS_SHOWN}")
        if self.aggregation == "ratio":
            if self.shape != "group_compare":
                raise ValueError("a ratio is defined for a whole table or a group comparison")
            if self.numerator is None or not self.numerator.enabled or self.numerator.problem():
                raise ValueError("a ratio needs a numerator condition")
        cells.require(df, self.fields())

    def fields(self) -> list[str]:
        """The columns the analysis reads."""
        ratio = self.aggregation == "ratio"
        names = [self.entity, self.time if self.shape == "trend" else self.group]
        names += [self.value] if self.aggregation in ("sum", "average") else []
        names += [r.field for r in (self.numerator, self.denominator) if ratio and r is not None and r.enabled]
        return list(dict.fromkeys(n for n in names if n))


def group_key(df: DataFrame, analysis: Analysis) -> Column:
    """What rows are grouped by: the first day of a period, or the native or text value."""
    if analysis.shape == "trend":
        return cells.period(cells.day(df, analysis.time), analysis.grain)
    return cells.identity(df, analysis.group)


def key_label(df: DataFrame, analysis: Analysis) -> Column:
    """The text a group is shown under, from its key; made once per group, not per row."""
    if analysis.shape == "trend":
        return cells.period_label(F.col("key"), analysis.grain)
    native = df.select(cells.col(analysis.group).alias("key"))
    return F.col("key") if cells.is_text(df, analysis.group) else cells.raw_text(native, "key")


def per_entity(df: DataFrame, analysis: Analysis) -> DataFrame:
    """One row per (in_scope, key, entity), NULL key and NULL entity included."""
    df = cells.normalised(df, analysis.fields())
    measured = analysis.aggregation in ("sum", "average")
    ratio = analysis.aggregation == "ratio"
    number = cells.number(df, analysis.value) if measured else F.lit(None).cast("double")
    prepared = df.select(
        (matches_category(df, analysis.denominator) if ratio else F.lit(True)).alias("in_scope"),
        group_key(df, analysis).alias("key"),
        cells.identity(df, analysis.entity).alias("entity"),
        number.alias("number"),
        (matches_category(df, analysis.numerator) if ratio else F.lit(False)).alias("hit"),
    )
    return prepared.groupBy("in_scope", "key", "entity").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("number").alias("valid_rows"),
        F.sum("number").alias("total"),
        F.max("hit").alias("hit"),
    )


def per_group(df: DataFrame, analysis: Analysis) -> DataFrame:
    """One row per (in_scope, key): the value and its accounting, nothing dropped.

    ``listed`` marks the groups of the result. It is an aggregate on purpose: a
    filter on the key itself would be pushed below both aggregations, where it
    evaluates the whole key expression a second time for every row.

    In a grouped average, a row without an entity is invalid and adds nothing.
    """
    analysis.check(df)
    known = F.col("entity").isNotNull()
    hits = F.count_if(known & F.col("hit"))
    entities = F.count("entity")
    average = analysis.aggregation == "average"
    counted = F.when(known, F.col("valid_rows")).otherwise(F.lit(0)) if average else F.col("valid_rows")
    total = F.sum(F.when(known, F.col("total"))) if average else F.sum("total")
    value = {
        "count_distinct": entities.cast("double"),
        "sum": total,
        "average": cells.safe_divide(total, F.count_if(known & (F.col("valid_rows") > 0))),
        "ratio": cells.safe_divide(hits, entities),
    }[analysis.aggregation]
    measured = analysis.aggregation in ("sum", "average")
    ratio = analysis.aggregation == "ratio"
    nothing = F.lit(None).cast("bigint")
    groups = per_entity(df, analysis).groupBy("in_scope", "key").agg(
        F.max(F.col("in_scope") & F.col("key").isNotNull()).alias("listed"),
        value.alias("value"),
        F.sum("rows").alias("source_rows"),
        entities.alias("distinct_entities"),
        F.sum(F.when(~known, F.col("rows")).otherwise(F.lit(0))).alias("missing_entity_rows"),
        (F.sum(F.col("rows") - counted) if measured else F.lit(0).cast("bigint")).alias("invalid_value_rows"),
        (hits if ratio else nothing).alias("numerator"),
        (entities if ratio else nothing).alias("denominator"),
    )
    return groups.withColumn("key", key_label(df, analysis))


def _finite() -> Column:
    v = F.col("value")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def _inside() -> Column:
    return F.col("listed")


RESULT = ("key", "value", "source_rows", "distinct_entities", "invalid_value_rows")


def _columns(analysis: Analysis) -> list[str]:
    return [*RESULT, "numerator", "denominator"] if analysis.aggregation == "ratio" else list(RESULT)


def order(analysis: Analysis) -> list[Column]:
    if analysis.shape == "trend":
        return [F.col("key").asc()]
    by_value = F.col("value").desc() if analysis.descending else F.col("value").asc()
    return [by_value, F.col("key").asc()]


def analyse(df: DataFrame, analysis: Analysis, groups: DataFrame | None = None) -> DataFrame:
    """Result rows in order. Top-N keeps exactly N: value first, then key.

    No gap is filled in a trend and no group without a value is shown.
    ``orderBy`` + ``limit`` is a TakeOrderedAndProject, never a full sort.
    """
    groups = per_group(df, analysis) if groups is None else groups
    rows = groups.filter(_inside() & _finite()).orderBy(*order(analysis))
    if analysis.shape == "top_n":
        rows = rows.limit(analysis.limit)
    return rows.select(*_columns(analysis))


def _total(of: str, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col(of))), F.lit(0))


def _books() -> list[Column]:
    return [
        _total("source_rows", F.lit(True)).alias("source_rows"),
        _total("source_rows", _inside()).alias("eligible_rows"),
        _total("source_rows", F.col("in_scope") & F.col("key").isNull()).alias("excluded_group_rows"),
        _total("source_rows", ~F.col("in_scope")).alias("excluded_scope_rows"),
        _total("missing_entity_rows", _inside()).alias("missing_entity_rows"),
        _total("invalid_value_rows", _inside()).alias("invalid_value_rows"),
        F.count_if(_inside() & _finite()).alias("group_count"),
        F.count_if(_inside() & ~_finite()).alias("groups_without_value"),
    ]


def accounting(df: DataFrame, analysis: Analysis, groups: DataFrame | None = None) -> DataFrame:
    """One row: where every source row went, and how many groups exist before any cut."""
    groups = per_group(df, analysis) if groups is None else groups
    return groups.agg(*_books())


def zero_denominators(df: DataFrame, analysis: Analysis, groups: DataFrame | None = None) -> DataFrame:
    """Groups whose ratio has no denominator; they are listed, not shown as 0 %."""
    groups = per_group(df, analysis) if groups is None else groups
    return groups.filter(_inside() & (F.col("denominator") == 0)).select("key", "source_rows")


def conflicts(df: DataFrame, analysis: Analysis) -> DataFrame:
    """Entities that sit in more than one group or are both a success and not.

    min <> max replaces two distinct counts, so this is one combinable pass.
    """
    analysis.check(df)
    df = cells.normalised(df, analysis.fields())
    prepared = df.select(
        cells.identity(df, analysis.entity).alias("entity"),
        F.when(matches_category(df, analysis.denominator), group_key(df, analysis)).alias("key"),
        matches_category(df, analysis.numerator).alias("hit"),
    )
    placed = F.col("key").isNotNull()
    hit = F.when(placed, F.col("hit"))
    return (
        prepared.groupBy("entity")
        .agg(
            (F.min("key") != F.max("key")).alias("many_groups"),
            (F.min(hit) != F.max(hit)).alias("many_outcomes"),
            F.count_if(placed).alias("rows"),
            F.max(F.col("entity").isNotNull()).alias("known"),
        )
        .filter(F.col("known") & (F.col("many_groups") | F.col("many_outcomes")))
        .drop("known")
    )


class ConflictError(ValueError):
    """The same entity carries contradictory groups or outcomes."""


def guarded_ratio(df: DataFrame, analysis: Analysis) -> DataFrame:
    """Ratio per group, refused while any entity is contradictory."""
    if not conflicts(df, analysis).isEmpty():
        raise ConflictError("an entity has several groups or outcomes; settle its final state first")
    return analyse(df, analysis)


def in_order(delivered: DataFrame, by: list[str], descending: bool = False) -> DataFrame:
    """One row (ordered, shown): do the rows come in the order of the columns, the first one descending if asked, ties ascending?

    Rows are compared with the one before them in their own partition. The first and last row of each partition, one
    row per partition, are then compared across the borders, so no window spans the result.
    """
    held = delivered.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]).alias("row"),
                            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    lead, lag = F.col("row.k0"), F.col("before.k0")
    beyond = lead < lag if descending else lead > lag
    right = F.col("before").isNull() | beyond | (lead.eqNullSafe(lag) & (F.col("row") >= F.col("before")))
    inside = held.withColumn("before", F.lag("row").over(Window.partitionBy("part").orderBy("place")))
    parts = inside.groupBy("part").agg(F.coalesce(F.min(F.coalesce(right, F.lit(False))), F.lit(True)).alias("ordered"), F.count(F.lit(1)).alias("shown"),
                                       F.min_by("row", "place").alias("row"), F.max_by("row", "place").alias("last"))
    across = parts.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    return across.agg(F.coalesce(F.min(F.col("ordered") & F.coalesce(right, F.lit(False))), F.lit(True)).alias("ordered"),
                      F.coalesce(F.sum("shown"), F.lit(0)).alias("shown"))


def result_checks(df: DataFrame, analysis: Analysis, groups: DataFrame | None = None, delivered: DataFrame | None = None) -> DataFrame:
    """(check, passed): reconciled rows, finite values, order, ratio bounds, N bound.

    ``delivered`` is the result as it was handed out, every row of it in its order; by default that of ``analyse``.
    """
    groups = per_group(df, analysis) if groups is None else groups
    delivered = analyse(df, analysis, groups) if delivered is None else delivered
    ordered = in_order(delivered, ["key"]) if analysis.shape == "trend" else in_order(delivered, ["value", "key"], analysis.descending)
    within = F.col("value").between(0, 1) & (F.col("numerator") <= F.col("denominator"))
    books = groups.agg(
        *_books(), F.coalesce(F.min(F.when(_inside() & _finite(), within)), F.lit(False)).alias("bounded")
    )
    placed = F.col("eligible_rows") + F.col("excluded_group_rows") + F.col("excluded_scope_rows")
    checks = [("rows_reconciled", F.col("source_rows") == placed), ("values_finite", F.col("group_count") > 0)]
    if analysis.aggregation == "ratio":
        checks.append(("ratio_bounds", F.col("bounded")))
    listed = [("in_order", F.col("ordered"))]
    if analysis.shape == "top_n":
        listed.append(("within_n", F.col("shown") <= F.lit(analysis.limit)))
    return check_rows(books, checks).unionByName(check_rows(ordered, listed))


def ranked(rows: DataFrame, by: str, key: str, n: int, descending: bool = True) -> DataFrame:
    """The N leading rows with their rank 1..N (ties broken by key).

    The cut comes first, so the rank window only ever sees N rows.
    """
    if not 1 <= n <= MOST_GROUPS_SHOWN:
        raise ValueError(f"N must be between 1 and {MOST_GROUPS_SHOWN}")
    lead = F.col(by).desc() if descending else F.col(by).asc()
    head = rows.orderBy(lead, F.col(key).asc()).limit(n)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(lead, F.col(key).asc())))


def with_share(rows: DataFrame, of: str, name: str = "share", total: Column | None = None) -> DataFrame:
    """Each row's part of the total (a scalar subquery unless the total is given)."""
    if total is None:
        total = rows.agg(F.sum(of)).scalar()
    return rows.withColumn(name, cells.safe_divide(F.col(of), total))
