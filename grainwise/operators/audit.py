"""Evidence that can leave the table: redacted, capped, checksummed, diffed."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions import cells

# Names whose content never leaves, and the size limits.
RAW_NAME = r"(?i)^(?:records?|rows?|raw(?:data)?|dataframe|cells?|values?|filecontent)$"
SECRET_NAME = r"(?i)^(?:api[_-]?key|authorization|password|secret|access[_-]?token|refresh[_-]?token)$"
LONGEST_LIST = 20
LIST_PREVIEW = 3
LONGEST_TEXT = 500
DEEPEST = 5
GROUPS_SHOWN = 100


def hidden(name: str) -> bool:
    return re.search(RAW_NAME, name) is not None or re.search(SECRET_NAME, name) is not None


def _scrub(c: Column, kind: T.DataType, depth: int) -> Column:
    if depth > DEEPEST:
        return F.lit("[nested too deeply]")
    if isinstance(kind, T.StringType):
        return F.when(F.length(c) > LONGEST_TEXT, F.concat(F.substring(c, 1, LONGEST_TEXT), F.lit("…[truncated]"))).otherwise(c)
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if not hidden(f.name)]
        if not kept:
            return F.lit("[removed]")
        inner = F.struct(*[_scrub(c[f.name], f.dataType, depth + 1).alias(f.name) for f in kept])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        size = F.size(c)
        head = F.when(size > LONGEST_LIST, F.slice(c, 1, LIST_PREVIEW)).otherwise(c)
        items = F.transform(head, lambda x: _scrub(x, kind.elementType, depth + 1))
        return F.when(c.isNotNull(), F.struct(size.cast("bigint").alias("item_count"), items.alias("items")))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(c, lambda k, v: ~(k.rlike(RAW_NAME) | k.rlike(SECRET_NAME)))
        return F.transform_values(kept, lambda k, v: _scrub(v, kind.valueType, depth + 1))
    return c


def redact(df: DataFrame) -> DataFrame:
    """The frame without raw-data and secret fields, with long lists and texts cut.

    Driven by the schema alone, so it is one projection whatever the nesting.
    A list becomes its length plus its items, the first three when it is long.
    """
    kept = [f for f in df.schema.fields if not hidden(f.name)]
    return df.select(*[_scrub(cells.col(f.name), f.dataType, 1).alias(f.name) for f in kept])


def checksum(names: list[str]) -> Column:
    """SHA-256 of a record in canonical form: columns by name, NULLs written out."""
    record = F.struct(*[cells.col(n).alias(n) for n in sorted(names)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def sealed(df: DataFrame) -> DataFrame:
    return df.withColumn("checksum", checksum(df.columns))


def seal_checks(df: DataFrame) -> DataFrame:
    """Rows of a sealed frame whose content no longer fits their checksum."""
    names = [c for c in df.columns if c != "checksum"]
    return df.withColumn("intact", F.col("checksum") == checksum(names))


def capped_groups(rows: DataFrame, order: list[Column], shown: int = GROUPS_SHOWN) -> DataFrame:
    """The first hundred result rows, each saying how many there are in all.

    This is the evidence extract of a result; the result itself stays whole.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    return (
        rows.orderBy(*order).limit(shown)
        .withColumn("group_count", total)
        .withColumn("truncated", F.col("group_count") > shown)
    )


def frozen_events(events: DataFrame, task: str, state: str, at: str) -> DataFrame:
    """Events of a task up to its last completion; open tasks keep all of theirs.

    The completion moment is one row per completed task. A task with very many events
    is an ordinary skewed join key, which AQE splits. Events without a task are no
    task: none of them freezes another.
    """
    done = events.filter(F.col(task).isNotNull()).groupBy(F.col(task).alias("__task")).agg(
        F.max(F.when(F.col(state) == "COMPLETED", F.col(at))).alias("completed_at")
    )
    return (
        events.join(done, F.col(task) == F.col("__task"), "left")
        .filter(F.col("completed_at").isNull() | (F.col(at) <= F.col("completed_at")))
        .drop("__task")
    )


def plan_changes(stages: DataFrame, plan: str, stage: str, order: list[str], fields: list[str]) -> DataFrame:
    """(plan, stage, field, before, after) for every field a stage changed.

    ``stages`` holds one row per plan and stage, ``order`` lists the stages. Each
    stage is compared with the one before it by a hash join on plan and place.
    """
    place = F.coalesce(*[F.when(F.col(stage) == s, F.lit(i)) for i, s in enumerate(order)])
    long = stages.select(F.col(plan).alias("plan"), place.alias("place"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), cells.col(f).cast("string").alias("value")) for f in fields
    ]))).filter(F.col("place").isNotNull())
    a, b = long.alias("a"), long.alias("b")
    linked = a.join(b, (F.col("a.plan") == F.col("b.plan")) & (F.col("a.field") == F.col("b.field"))
                    & (F.col("a.place") + 1 == F.col("b.place")))
    name = F.element_at(F.array(*[F.lit(s) for s in order]), F.col("b.place") + 1)
    return linked.filter(~F.col("a.value").eqNullSafe(F.col("b.value"))).select(
        F.col("a.plan").alias("plan"), name.alias("stage"), F.col("a.field").alias("field"),
        F.col("a.value").alias("before"), F.col("b.value").alias("after"),
    )


def task_summary(calls: DataFrame, events: DataFrame, task: str, at: str) -> DataFrame:
    """One row per task: last state, events, and its tools with how often each ended how.

    Calls are counted per (task, tool, status) first, so the list per task is as
    long as the tool vocabulary, not as the log.
    """
    tools = (
        calls.groupBy(task, "tool", "status").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(task).agg(
            F.sum("n").alias("calls"),
            F.array_sort(F.collect_list(F.struct("tool", "status", "n"))).alias("tools"),
        )
    )
    last = events.groupBy(task).agg(
        F.count(F.lit(1)).alias("events"), F.max_by("state", F.col(at)).alias("state"),
        F.min(at).alias("started_at"), F.max(at).alias("updated_at"),
    )
    return last.join(tools, task, "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
