"""Operational event logs: state transitions, write log, call budget, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.operators.history import Carry, with_earlier

# The states of an analysis task and where each may go next.
TRANSITIONS = {
    "IDLE": ["DATA_PROFILED", "FAILED"],
    "DATA_PROFILED": ["PLANNING", "DATA_VERSION_CHANGED", "FAILED"],
    "PLANNING": ["NEEDS_CLARIFICATION", "NEEDS_APPROVAL", "READY_TO_EXECUTE", "UNSUPPORTED", "FAILED",
                 "DATA_VERSION_CHANGED"],
    "NEEDS_CLARIFICATION": ["PLANNING", "UNSUPPORTED", "FAILED", "DATA_VERSION_CHANGED"],
    "NEEDS_APPROVAL": ["READY_TO_EXECUTE", "NEEDS_REVISION", "NEEDS_JOIN_REVISION", "FAILED", "DATA_VERSION_CHANGED"],
    "READY_TO_EXECUTE": ["EXECUTING", "NEEDS_REVISION", "NEEDS_JOIN_REVISION", "FAILED", "DATA_VERSION_CHANGED"],
    "EXECUTING": ["VALIDATING", "FAILED", "DATA_VERSION_CHANGED"],
    "VALIDATING": ["COMPLETED", "NEEDS_REVISION", "NEEDS_JOIN_REVISION", "FAILED", "DATA_VERSION_CHANGED"],
    "COMPLETED": ["DATA_VERSION_CHANGED"],
    "NEEDS_REVISION": ["PLANNING", "NEEDS_APPROVAL", "READY_TO_EXECUTE", "FAILED", "DATA_VERSION_CHANGED"],
    "NEEDS_JOIN_REVISION": ["PLANNING", "NEEDS_APPROVAL", "FAILED", "DATA_VERSION_CHANGED"],
    "DATA_VERSION_CHANGED": ["DATA_PROFILED", "FAILED"],
    "UNSUPPORTED": ["PLANNING", "FAILED", "DATA_VERSION_CHANGED"],
    "FAILED": ["PLANNING", "DATA_PROFILED", "DATA_VERSION_CHANGED"],
}
FIRST_STATES = ["IDLE", "DATA_PROFILED"]
CALL_CAP = 20


def allowed(before: Column, after: Column) -> Column:
    """May a task go from one state to the other? A first event must be a first state."""
    test = F.when(before.isNull(), after.isin(FIRST_STATES))
    for state, targets in TRANSITIONS.items():
        test = test.when(before == state, after.isin(targets))
    return test.otherwise(F.lit(False))


def check_transitions(log: DataFrame, task: str, state: str, order: list[str], chunk: Column) -> DataFrame:
    """The log with the previous state of its task and whether the step is allowed."""
    earlier = with_earlier(log, [task], chunk, order, [Carry("from_state", "last", F.col(state))])
    return earlier.withColumn("valid", allowed(F.col("from_state"), F.col(state)))


def call_budget(calls: DataFrame, input_tokens: str, output_tokens: str, cap: int = CALL_CAP) -> DataFrame:
    """How much of a fixed lifetime budget the calls used; one combinable aggregate."""
    i, o = F.col(input_tokens), F.col(output_tokens)
    n = F.count(F.lit(1))
    return calls.agg(
        F.least(n, F.lit(cap)).cast("bigint").alias("reserved"),
        F.greatest(F.lit(0), F.lit(cap) - n).cast("bigint").alias("remaining"),
        F.greatest(F.lit(0), n - F.lit(cap)).cast("bigint").alias("refused"),
        n.alias("recorded"),
        F.coalesce(F.sum(i), F.lit(0)).cast("bigint").alias("known_input_tokens"),
        F.coalesce(F.sum(o), F.lit(0)).cast("bigint").alias("known_output_tokens"),
        F.count_if(i.isNull() | o.isNull()).alias("unknown_usage_calls"),
    )


def granted_calls(calls: DataFrame, order: list[str], cap: int = CALL_CAP) -> DataFrame:
    """The calls that got a reservation: the first ``cap`` in order."""
    return calls.orderBy(*order).limit(cap)


def visible_to_owner(rows: DataFrame, owners: DataFrame, row_id: str, owner_id: str, owner_hash: str) -> DataFrame:
    """Rows whose recorded owner is the asking one; a row without an owner is invisible."""
    mine = owners.filter(F.col("owner_hash") == F.lit(owner_hash)).select(F.col(owner_id).alias("__id"))
    return rows.join(mine, F.col(row_id) == F.col("__id"), "left_semi")


def with_owner_check(rows: DataFrame, owners: DataFrame, row_id: str, owner_id: str, asking: Column) -> DataFrame:
    """Rows asked for by many owners at once: only those where the hash matches stay."""
    o = owners.select(F.col(owner_id).alias("__id"), F.col("owner_hash").alias("__hash"))
    return rows.join(o, (F.col(row_id) == F.col("__id")) & (asking == F.col("__hash")), "left_semi")


def owner_hash(subject: Column) -> Column:
    return F.sha2(F.concat(F.lit("owner:"), subject), 256)


def expired(buckets: DataFrame, expires_at: str, now: Column, keep: str = "1 day") -> DataFrame:
    """Counter buckets that ended longer ago than ``keep`` and may be deleted."""
    return buckets.filter(F.col(expires_at) < now - F.expr(f"INTERVAL {keep}"))
