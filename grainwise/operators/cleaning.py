"""Approved repairs on a derived copy, with a receipt. The source is never changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.operators import quality

KINDS = ("deduplicate_exact", "drop_missing", "drop_invalid_date")


@dataclass(frozen=True)
class Repair:
    kind: str
    field: str | None = None

    @property
    def label(self) -> str:
        return self.kind if self.field is None else f"{self.kind}({self.field})"


def _plan(df: DataFrame, repairs: list[Repair]) -> tuple[bool, list[Repair]]:
    """Deduplication goes first, the row rules keep their order."""
    if not repairs:
        raise ValueError("select at least one repair")
    for r in repairs:
        if r.kind not in KINDS or (r.kind != "deduplicate_exact" and not r.field):
            raise ValueError(f"not a repair: {r}")
    cells.require(df, [r.field for r in repairs])
    return (any(r.kind == "deduplicate_exact" for r in repairs),
            [r for r in repairs if r.kind != "deduplicate_exact"])


def fails(df: DataFrame, repair: Repair) -> Column:
    """True where the row must go. A missing date is not an invalid one."""
    if repair.kind == "drop_missing":
        return cells.missing(df, repair.field)
    return ~cells.missing(df, repair.field) & cells.day(df, repair.field).isNull()


def keep_first(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per set of identical rows: the first by ``order_by``.

    Without an order column the smallest row wins, which makes the result
    independent of how Spark read the table. This is an aggregate, not a window:
    copies are folded inside each task, so a row repeated on a third of the
    table does not end up in one partition.
    """
    row = F.struct(*[cells.col(c) for c in df.columns])
    if order_by:
        cells.require(df, order_by)
        rest = [c for c in df.columns if c not in order_by]
        digest = cells.row_digest(df, rest)
        first = F.min_by(row, F.struct(*[cells.col(c) for c in order_by]))
    else:
        digest, first = cells.row_digest(df), F.min(row)
    return df.groupBy(digest.alias("__digest")).agg(first.alias("__row")).select("__row.*")


def clean(df: DataFrame, repairs: list[Repair], order_by: list[str] | None = None) -> DataFrame:
    """Derived copy with the repairs applied.

    Copies of a row agree on every trimmed cell, so the row rules give the same
    answer for all of them. They can run before deduplication: the result is
    the same and fewer rows are shuffled. ``order_by`` names ordinal columns
    that identify rows and are left out of the comparison.
    """
    deduplicate, rules = _plan(df, repairs)
    out = df
    for rule in rules:
        out = out.filter(~fails(out, rule))
    return keep_first(out, order_by) if deduplicate else out


def clean_or_refuse(df: DataFrame, repairs: list[Repair], order_by: list[str] | None = None) -> DataFrame:
    out = clean(df, repairs, order_by)
    if out.isEmpty():
        raise ValueError("these repairs would remove every row")
    return out


def _folded(df: DataFrame, rules: list[Repair], order_by: list[str] | None) -> DataFrame:
    """Per set of identical rows: how many copies, and which rules it fails."""
    compared = [c for c in df.columns if c not in (order_by or [])]
    flags = [fails(df, r).alias(f"f{i}") for i, r in enumerate(rules)]
    return df.select(cells.row_digest(df, compared).alias("d"), *flags).groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(f"f{i}").alias(f"f{i}") for i in range(len(rules))]
    )


def receipt(df: DataFrame, repairs: list[Repair], order_by: list[str] | None = None) -> DataFrame:
    """(step, action, affected_rows, rows_after), in the order the repairs apply.

    One pass: a row is charged to the first rule it fails, which is what
    counting after each step would give. Only digests and flags are shuffled.
    """
    deduplicate, rules = _plan(df, repairs)
    folded = _folded(df, rules, order_by)
    weight = F.lit(1) if deduplicate else F.col("n")
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("source"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies")]
    alive = F.lit(True)
    for i in range(len(rules)):
        sums.append(F.coalesce(F.sum(F.when(alive & F.col(f"f{i}"), weight)), F.lit(0)).alias(f"a{i}"))
        alive = alive & ~F.col(f"f{i}")
    steps = [("deduplicate_exact", F.col("copies"))] if deduplicate else []
    steps += [(r.label, F.col(f"a{i}")) for i, r in enumerate(rules)]
    left = F.col("source")
    rows = []
    for step, (label, affected) in enumerate(steps):
        left = left - affected
        rows.append(F.struct(
            F.lit(step).cast("bigint").alias("step"), F.lit(label).alias("action"),
            affected.cast("bigint").alias("affected_rows"), left.cast("bigint").alias("rows_after"),
        ))
    return folded.agg(*sums).select(F.inline(F.array(*rows)))


def before_and_after(
    source: DataFrame,
    derived: DataFrame,
    names: list[str] | None = None,
    ids: list[str] | None = None,
    dates: list[str] | None = None,
) -> DataFrame:
    """Rows, findings and skipped checks of both versions, one row."""
    names = names or source.columns
    ids, dates = quality.resolve_roles(source, names, ids, dates)
    after_stats = quality.column_stats(derived, names)
    after = quality.issues(derived, names, ids, dates, after_stats)
    one = F.count(F.lit(1))
    return source.agg(one.alias("source_rows")).select(
        "source_rows",
        derived.agg(one).scalar().alias("result_rows"),
        quality.issues(source, names, ids, dates).agg(one).scalar().alias("issues_before"),
        after.agg(one).scalar().alias("issues_after"),
        quality.skipped_checks(after_stats, ids).agg(one).scalar().alias("checks_skipped_after"),
    ).withColumn("removed_rows", F.col("source_rows") - F.col("result_rows"))


def scope(source: DataFrame, derived: DataFrame, entity: str) -> DataFrame:
    """Rows and distinct entities on both sides of a repair, one row per side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return (
            df.groupBy(cells.identity(df, entity).alias("e")).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("e").alias("distinct_entities"))
            .select(F.lit(name).alias("version"), "rows", "distinct_entities")
        )
    return side(source, "source").unionByName(side(derived, "derived"))


def strict_clean(
    df: DataFrame, required: list[str], date: str, order_by: list[str] | None = None
) -> DataFrame:
    """The fixed recipe: no copies, no missing required field, a real date in every row."""
    cells.require(df, [*required, date])
    keep = cells.day(df, date).isNotNull()
    for name in required:
        keep = keep & ~cells.missing(df, name)
    return keep_first(df.filter(keep), order_by)
