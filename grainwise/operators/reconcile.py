"""Did a join change any amount? Source totals against joined totals, per field."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.operators import keys

# Fixed value: field names that hold an amount.
AMOUNT_NAME = (
    r"(?i)(?:^|[_\s.-])(?:amount|price|gmv|revenue|sales|income|cost|fee|freight|tax|refund"
    r"|payment(?:[_\s.-]?value)?|金额|价格|销售额|收入|营收|成本|运费|税费|退款)(?:$|[_\s.-])"
)


def amount_fields(names: list[str]) -> list[str]:
    return [n for n in names if re.search(AMOUNT_NAME, n)]


def _lines(occurrences: Column, valid: Column, total: Column, prefix: str) -> list[Column]:
    """Aggregates over frames of (occurrences in the output, valid rows, their sum)."""
    def added(value: Column, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0))

    repeated, dropped = occurrences > 1, occurrences == 0
    return [
        added(total).cast("double").alias(f"{prefix}source_total"),
        added(total * occurrences).cast("double").alias(f"{prefix}output_total"),
        added(valid).cast("bigint").alias(f"{prefix}valid_source_rows"),
        added(valid * occurrences).cast("bigint").alias(f"{prefix}output_value_rows"),
        added(valid, repeated).cast("bigint").alias(f"{prefix}duplicated_source_rows"),
        added(valid, dropped).cast("bigint").alias(f"{prefix}excluded_source_rows"),
        added(total * (occurrences - 1), repeated).cast("double").alias(f"{prefix}duplication_impact"),
        added(total, dropped).cast("double").alias(f"{prefix}exclusion_impact"),
    ]


FIGURES = (
    "source_total", "output_total", "valid_source_rows", "output_value_rows", "duplicated_source_rows",
    "excluded_source_rows", "duplication_impact", "exclusion_impact",
)


def _report(row: DataFrame, fields: list[tuple[str, str, str]]) -> DataFrame:
    """One row per amount field out of a one-row frame of prefixed figures."""
    structs = [
        F.struct(F.lit(table).alias("table"), F.lit(name).alias("field"),
                 *[F.col(f"{prefix}{f}").alias(f) for f in FIGURES])
        for prefix, table, name in fields
    ]
    twice, gone = F.col("duplicated_source_rows") > 0, F.col("excluded_source_rows") > 0
    return (
        row.select(F.inline(F.array(*structs)))
        .withColumn("net_delta", F.col("output_total") - F.col("source_total"))
        .withColumn("net_delta_rate", cells.safe_divide(F.col("net_delta"), F.abs("source_total")))
        .withColumn(
            "status",
            F.when(twice & gone, F.lit("mixed")).when(twice, F.lit("duplicated"))
            .when(gone, F.lit("excluded")).otherwise(F.lit("balanced")),
        )
    )


def reconcile_join(
    left: DataFrame, right: DataFrame, on: keys.Pairs, how: str,
    left_amounts: list[str], right_amounts: list[str], left_name: str = "left", right_name: str = "right",
) -> DataFrame:
    """Reconciliation of a single join without running it.

    All rows of one key occur equally often in the output: as often as the other
    side has that key. So per-key row counts and sums of both sides, joined on
    the key, give the same figures as tracing every row through the join, at the
    price of two combinable aggregates and one join of one-row-per-key frames.
    """
    if not left_amounts and not right_amounts:
        raise ValueError("name at least one amount field")
    cells.require(left, left_amounts)
    cells.require(right, right_amounts)
    tags = keys.type_tags(left, right, on)

    def measures(df: DataFrame, names: list[str], side: str) -> list[Column]:
        return [
            agg for i, n in enumerate(names)
            for agg in (F.count(cells.number(df, n)).alias(f"{side}v{i}"), F.sum(cells.number(df, n)).alias(f"{side}s{i}"))
        ]

    l = keys.key_counts(left, [a for a, _ in on], "left_n", tags, measures(left, left_amounts, "l")).alias("l")
    r = keys.key_counts(right, [b for _, b in on], "right_n", tags, measures(right, right_amounts, "r")).alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.k{i}") == F.col(f"r.k{i}") for i in range(len(on))])
    both = l.join(r, same, "full_outer")
    times_left = F.coalesce("right_n", F.lit(1 if how == "left" else 0))
    times_right = F.coalesce("left_n", F.lit(0))
    lines, fields = [], []
    for i, n in enumerate(left_amounts):
        lines += _lines(times_left, F.col(f"lv{i}"), F.col(f"ls{i}"), f"l{i}_")
        fields.append((f"l{i}_", left_name, n))
    for i, n in enumerate(right_amounts):
        lines += _lines(times_right, F.col(f"rv{i}"), F.col(f"rs{i}"), f"r{i}_")
        fields.append((f"r{i}_", right_name, n))
    return _report(both.agg(*lines), fields)


def row_identity() -> Column:
    """Identity of a row read from files: file path and position in it.

    Unlike a generated id it is the same in every scan and after a lost executor.
    """
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def with_row_identity(df: DataFrame, name: str = "row_ref") -> DataFrame:
    """For frames read directly from Parquet."""
    return df.withColumn(name, row_identity())


def with_row_number(df: DataFrame, name: str = "row_ref") -> DataFrame:
    """The same identity in sixteen bytes, for tracing through shuffles: a 64-bit hash of the file's path, position in it.

    Two of n files share a hash with a probability of about n * n / 2**65.
    """
    return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def reconcile_rows(output: DataFrame, source: DataFrame, source_id: str, output_id: str, amounts: list[str],
                   table: str) -> DataFrame:
    """Reconciliation through any number of joins, by tracing row ids.

    ``source_id`` is unique in the source; ``output_id`` is the column that
    carries it in the joined frame. Occurrences are counted with map-side
    combining, so a dimension row used by a third of the output is one row per
    task.
    """
    cells.require(source, [source_id, *amounts])
    cells.require(output, [output_id])
    uses = (
        output.filter(cells.col(output_id).isNotNull()).groupBy(cells.col(output_id).alias("__id"))
        .agg(F.count(F.lit(1)).alias("__times"))
    )
    values = [cells.number(source, n).alias(f"a{i}") for i, n in enumerate(amounts)]
    traced = source.select(cells.col(source_id).alias("__sid"), *values).join(uses, F.col("__sid") == F.col("__id"), "left")
    times = F.coalesce("__times", F.lit(0))
    lines, fields = [], []
    for i, n in enumerate(amounts):
        lines += _lines(times, F.col(f"a{i}").isNotNull().cast("int"), F.col(f"a{i}"), f"f{i}_")
        fields.append((f"f{i}_", table, n))
    return _report(traced.agg(*lines), fields)


def unbalanced(reports: DataFrame) -> DataFrame:
    """Fields whose joined total must not be summed or averaged."""
    return reports.filter(F.col("status") != "balanced").select("table", "field", "status", "net_delta")


class UnsafeAmount(ValueError):
    """The amount was duplicated or dropped by the join it went through."""


def require_balanced(reports: DataFrame, table: str, field: str) -> None:
    """Guard before summing ``field`` of a joined frame."""
    bad = reports.filter((F.col("table") == table) & (F.col("field") == field) & (F.col("status") != "balanced"))
    row = bad.select("status").first()
    if row is not None:
        raise UnsafeAmount(f"{table}.{field} is {row['status']} after the join; aggregate it at its own grain first")
