"""Column profiles, candidate keys, table fingerprints, role suggestions, control totals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from grainwise.functions import cells

# Column names that read as an identifier, a date, an order, ...
IDENTIFIER_NAME = r"(?i)(?:^|[_\s-])(?:id|key|code|no|number)(?:$|[_\s-])|编号|编码|单号|主键"
DATE_NAME = r"(?i)date|time|日期|时间"
ITEM_KEY_NAME = r"(?i)order.*item|item.*id|明细"
ORDER_KEY_NAME = r"(?i)order|订单"
CUSTOMER_KEY_NAME = r"(?i)customer|user|member|客户|用户|会员"
ORDER_ID_NAME = r"(?i)^(?:.*\.)?order_id$|订单(?:编号|号)"
STATUS_NAME = r"(?i)^(?:.*\.)?(?:order_)?status$|状态"
EXAMPLE_LENGTH = 28
EXAMPLES_SHOWN = 3
# Values longer than this are identified by a prefix and a digest in a shuffle.
LONG_VALUE = 64


def looks_like_identifier(name: str) -> bool:
    return re.search(IDENTIFIER_NAME, name) is not None


def looks_like_date(name: str) -> bool:
    return re.search(DATE_NAME, name) is not None


def column_stats(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per column: rows, missing, cells per class, inferred type.

    One scan. Each row is unfolded into its cells, a single expression classifies
    them, and the counts are combined before the shuffle: what travels is one row
    of counters per column and task. The generated code stays the same size
    however wide the table is.
    """
    names = names or df.columns
    cells.require(df, names)
    entries = []
    for i, name in enumerate(names):
        text = cells.is_text(df, name)
        entries.append(F.struct(
            F.lit(i).cast("bigint").alias("position"),
            (cells.text(df, name) if text else F.lit(None).cast("string")).alias("cell"),
            (F.lit(None).cast("string") if text else cells.cell_class(df, name)).alias("class"),
        ))
    classed = df.select(F.inline(F.array(*entries))).select(
        "position", F.coalesce("class", cells.class_of_text(F.col("cell"))).alias("class")
    )
    column = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("position") + 1).cast("int"))
    inferred = F.when(F.col("present") == 0, F.lit("empty"))
    for kind in cells.CLASSES:
        inferred = inferred.when(F.col(f"{kind}_cells") == F.col("present"), F.lit(kind))
    return classed.groupBy("position").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("class") == kind).alias(f"{kind}_cells") for kind in cells.CLASSES],
        F.count("class").alias("present"),
    ).select(
        column.alias("column"), "position", "rows", *[f"{kind}_cells" for kind in cells.CLASSES], "present",
        (F.col("rows") - F.col("present")).alias("missing"),
        cells.safe_divide(F.col("rows") - F.col("present"), F.col("rows")).alias("missing_rate"),
        inferred.otherwise(F.lit("mixed")).alias("inferred_type"),
    )


def distinct_values(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, value, rows): every distinct present value, untrimmed.

    Long values travel as a 27-character prefix plus a digest, so a column of
    documents shuffles about 100 bytes per distinct value.
    """
    names = names or df.columns
    cells.require(df, names)
    pairs = []
    for name in names:
        raw = cells.raw_text(df, name)
        short = F.when(F.length(raw) <= LONG_VALUE, raw).otherwise(
            F.concat(F.substring(raw, 1, EXAMPLE_LENGTH - 1), F.lit("…"), F.sha2(raw, 256))
        )
        value = F.when(~cells.missing(df, name), short)
        pairs.append(F.struct(F.lit(name).alias("column"), value.alias("value")))
    return (
        df.select(F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _shown(value: Column) -> Column:
    cut = F.concat(F.substring(value, 1, EXAMPLE_LENGTH - 1), F.lit("…"))
    return F.when(F.length(value) > EXAMPLE_LENGTH, cut).otherwise(value)


def examples(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The first three distinct display values per column, in text order.

    ``row_number() <= 3`` becomes a group limit that keeps three rows per column
    and partition before the shuffle.
    """
    first = Window.partitionBy("column").orderBy("example")
    return (
        distinct_values(df, names)
        .select("column", _shown(F.col("value")).alias("example"))
        .distinct()
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= EXAMPLES_SHOWN)
    )


def column_profile(
    df: DataFrame,
    names: list[str] | None = None,
    keys: list[str] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Stats plus distinct count and candidate-key flag, one row per column.

    ``keys`` names columns to treat as identifiers besides those that look like
    one. ``exact=False`` swaps the distinct shuffle for a sketch inside one scan;
    a sketch cannot prove uniqueness, so ``candidate_key`` is then NULL.
    """
    names = names or df.columns
    stats = column_stats(df, names)
    if exact:
        unique = distinct_values(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    else:
        sketches = df.agg(*[
            F.approx_count_distinct(F.when(~cells.missing(df, n), cells.raw_text(df, n))).alias(f"u{i}")
            for i, n in enumerate(names)
        ])
        unique = sketches.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("column"), F.col(f"u{i}").alias("unique")) for i, n in enumerate(names)
        ])))
    identifier = F.col("column").isin([n for n in names if looks_like_identifier(n) or n in (keys or [])])
    proven = (
        F.col("identifier") & (F.col("missing") == 0) & (F.col("unique") == F.col("rows")) & (F.col("rows") > 0)
    )
    return (
        # at most one row per column of the table on either side
        stats.join(F.broadcast(unique), "column", "left")
        .withColumn("unique", F.coalesce("unique", F.lit(0)))
        .withColumn("identifier", identifier)
        .withColumn("candidate_key", proven if exact else F.lit(None).cast("boolean"))
    )


def candidate_keys(profile: DataFrame) -> DataFrame:
    return profile.filter("candidate_key").select("column", "position", "rows")


def grain(profile: DataFrame) -> DataFrame:
    """What one row stands for, read off the first candidate key."""
    first = F.min_by("column", F.when(F.col("candidate_key"), F.col("position")))
    key = F.col("key")
    return profile.agg(first.alias("key")).select(
        "key",
        F.when(key.isNull(), F.lit("no single-column key"))
        .when(key.rlike(ITEM_KEY_NAME), F.lit("one row per order item"))
        .when(key.rlike(ORDER_KEY_NAME), F.lit("one row per order"))
        .when(key.rlike(CUSTOMER_KEY_NAME), F.lit("one row per customer"))
        .otherwise(F.lit("one row per record")).alias("grain"),
    )


def fingerprint(df: DataFrame, dataset: str) -> DataFrame:
    """One row naming the exact content of a table, independent of row order.

    Three mergeable aggregates over a 64-bit row hash: XOR, wide sum and count.
    XOR alone would miss a row added twice; the sum does not. Each cell is hashed
    with a NULL flag, because the hash function itself passes over NULLs.
    """
    texts = [cells.raw_text(df, n) for n in df.columns]
    digest = F.xxhash64(*[part for c in texts for part in (c.isNull(), c)])
    names = "\u001e".join(df.columns)
    return df.select(digest.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"),
    ).select(
        F.lit(dataset).alias("dataset"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.sha2(F.concat_ws("|", F.lit(names), F.hex("x"), F.col("s").cast("string"), F.col("rows").cast("string")), 256)
        .alias("fingerprint"),
    )


def version_changes(bound: DataFrame, current: DataFrame) -> DataFrame:
    """Per dataset: unchanged, changed, added or removed since it was bound."""
    b, c = bound.alias("b"), current.alias("c")
    same = F.col("b.fingerprint") == F.col("c.fingerprint")
    return b.join(c, F.col("b.dataset") == F.col("c.dataset"), "full_outer").select(
        F.coalesce("b.dataset", "c.dataset").alias("dataset"),
        F.col("b.rows").alias("bound_rows"),
        F.col("c.rows").alias("current_rows"),
        F.when(F.col("b.dataset").isNull(), F.lit("added"))
        .when(F.col("c.dataset").isNull(), F.lit("removed"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("changed")).alias("status"),
    )


def same_versions(bound: DataFrame, current: DataFrame) -> bool:
    """Set equality of versions, as two empty differences."""
    pick = ["dataset", "fingerprint"]
    b, c = bound.select(pick), current.select(pick)
    return b.exceptAll(c).isEmpty() and c.exceptAll(b).isEmpty()


def planner_summary(profile: DataFrame) -> DataFrame:
    """What may leave with a question: names and statistics, no cell of any row."""
    return profile.select("column", "inferred_type", "missing_rate", "unique", "candidate_key")


def suggest_roles(profile: DataFrame) -> DataFrame:
    """Default entity, value, time, group and status columns, one row.

    The first column in table order that qualifies; a later fallback is only
    used when no column qualifies for the earlier one.
    """
    name, place = F.col("column"), F.col("position")

    def first(condition: Column) -> Column:
        return F.min_by(name, F.when(condition, place))

    entity = F.coalesce(first(F.col("candidate_key")), first(F.col("identifier")), F.min_by(name, place))
    picked = profile.agg(
        entity.alias("entity"),
        first(name.rlike(ORDER_ID_NAME)).alias("order_entity"),
        first((F.col("inferred_type") == "date") | name.rlike(DATE_NAME)).alias("time"),
        first(name.rlike(STATUS_NAME)).alias("status"),
    )
    # value and group must differ from the entity, which is a one-row subquery
    chosen = picked.select("entity").scalar()
    other = profile.withColumn("other", name != chosen).agg(
        first((F.col("inferred_type") == "number") & F.col("other")).alias("value"),
        first((F.col("inferred_type") == "text") & F.col("other")).alias("group"),
    )
    return picked.select(
        "entity", "order_entity",
        other.select("value").scalar().alias("value"),
        "time",
        other.select("group").scalar().alias("group"),
        "status",
    )


def control_totals(df: DataFrame, entity: str, amount: str, group: str) -> DataFrame:
    """Arithmetic controls of a delivered table, one row.

    Group sums plus the amount without a group must give the grand total.
    """
    cells.require(df, [entity, amount, group])
    ids = (
        df.select(cells.identity(df, entity).alias("id")).filter(F.col("id").isNotNull())
        .groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("n") > 1).alias("repeated"))
    )
    copies = (
        df.select(cells.row_digest(df).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("groups"))
    )
    value = cells.number(df, amount)
    sums = df.select(cells.text(df, group).alias("g"), value.alias("v")).groupBy("g").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("valid"), F.sum("v").alias("s")
    )
    grouped = F.coalesce(F.sum(F.when(F.col("g").isNotNull(), F.col("s"))), F.lit(0.0))
    loose = F.coalesce(F.sum(F.when(F.col("g").isNull(), F.col("s"))), F.lit(0.0))
    total = F.coalesce(F.sum("s"), F.lit(0.0))
    return sums.agg(
        F.sum("rows").alias("rows"),
        ids.select("ids").scalar().alias("distinct_entities"),
        ids.select("repeated").scalar().alias("repeated_entities"),
        copies.scalar().alias("duplicate_row_groups"),
        total.alias("amount_total"),
        grouped.alias("amount_in_groups"),
        loose.alias("amount_without_group"),
        F.coalesce(F.sum(F.when(F.col("g").isNull(), F.col("rows"))), F.lit(0)).alias("rows_without_group"),
        F.sum(F.col("rows") - F.col("valid")).alias("rows_without_amount"),
        (F.abs(grouped + loose - total) < 0.01).alias("reconciled"),
    )
