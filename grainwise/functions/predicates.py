"""Structured filter rules compiled to Column expressions.

Operands are always literals, never text spliced into SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells

OPERATORS = (
    "equals", "not_equals", "greater", "greater_equal",
    "less", "less_equal", "contains", "not_empty",
)
CATEGORICAL = ("equals", "not_equals", "not_empty")


@dataclass(frozen=True)
class FilterRule:
    field: str
    operator: str
    value: str = ""
    enabled: bool = True

    def problem(self) -> str | None:
        if not self.enabled:
            return None
        if self.operator not in OPERATORS:
            return f"unknown operator {self.operator!r}"
        if not self.field:
            return "the rule names no field"
        if self.operator != "not_empty" and not self.value.strip():
            return "the rule has no operand"
        return None


def operand_number(value: str) -> float | None:
    """Number an operand stands for, or None when it is plain text."""
    t = value.strip()
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", t):
        return float(int(t, 0))
    return float(t) if re.match(cells.OPERAND_PATTERN, t) else None


def operand_moment(value: str) -> datetime | None:
    """UTC moment an operand with '-' or '/' stands for, or None."""
    t = value.strip().replace("/", "-")
    if "-" not in t:
        return None
    shape = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(.*)", t, re.S)
    if not shape:
        return None
    year, month, day, clock = shape.groups()
    try:
        moment = datetime.fromisoformat(f"{year}-{int(month):02d}-{int(day):02d}{clock}")
    except ValueError:
        return None
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def _compare(left: Column, operator: str, right: Column) -> Column:
    return {
        "equals": left == right,
        "not_equals": left != right,
        "greater": left > right,
        "greater_equal": left >= right,
        "less": left < right,
        "less_equal": left <= right,
    }[operator]


def matches(df: DataFrame, rule: FilterRule | None) -> Column:
    """Condition of the rule. NULL (a missing cell) means "no match", also for not_equals.

    The condition stays three-valued so that a filter on it is pushed to the
    scan; use ``matched`` where a strict boolean is needed.
    The operand's type is settled once, here. Per row only the cell is cast:
    numeric operand -> numeric comparison where the cell is a number, dated
    operand -> comparison in time where the cell is a timestamp, else
    case-insensitive text. Native typed columns compare natively, so the
    predicate is pushed to the scan.
    """
    if rule is None or not rule.enabled:
        return F.lit(True)
    problem = rule.problem()
    if problem:
        raise ValueError(problem)
    cells.require(df, [rule.field])
    kind = cells.family(df, rule.field)
    c = cells.col(rule.field)
    if rule.operator == "not_empty":
        return ~cells.missing(df, rule.field)
    t = cells.text(df, rule.field)
    wanted = F.lower(F.lit(rule.value.strip()))
    if rule.operator == "contains":
        return F.contains(F.lower(t), F.lower(F.lit(rule.value)))
    as_text = _compare(F.lower(t), rule.operator, wanted)
    target = operand_number(rule.value)
    moment = operand_moment(rule.value) if target is None else None
    if target is not None and kind == "number":
        return _compare(c, rule.operator, F.lit(int(target) if target.is_integer() else target))
    if target is not None and kind == "text":
        cell = F.when(t.rlike(cells.OPERAND_PATTERN), t.try_cast("double"))
        return F.when(cell.isNotNull(), _compare(cell, rule.operator, F.lit(target))).otherwise(as_text)
    if moment is not None and kind == "date":
        literal = F.to_timestamp_ntz(F.lit(moment.isoformat(sep=" ")))
        return _compare(c, rule.operator, literal.cast(cells.data_type(df, rule.field)))
    if moment is not None and kind == "text":
        cell = F.translate(t, "/", "-").try_cast("timestamp_ntz")
        literal = F.to_timestamp_ntz(F.lit(moment.isoformat(sep=" ")))
        return F.when(cell.isNotNull(), _compare(cell, rule.operator, literal)).otherwise(as_text)
    return as_text


def matched(df: DataFrame, rule: FilterRule | None) -> Column:
    return F.coalesce(matches(df, rule), F.lit(False))


def matches_category(df: DataFrame, rule: FilterRule | None) -> Column:
    """Ratio conditions are categorical: trimmed, case-insensitive, three operators."""
    if rule is None or not rule.enabled:
        return F.lit(True)
    if rule.operator not in CATEGORICAL:
        raise ValueError(f"a ratio condition must use one of {CATEGORICAL}")
    cells.require(df, [rule.field])
    t = F.lower(cells.text(df, rule.field))
    if rule.operator == "not_empty":
        return t.isNotNull()
    return F.coalesce(_compare(t, rule.operator, F.lower(F.lit(rule.value.strip()))), F.lit(False))


def in_window(c: Column, start: str, end: str) -> Column:
    """Half-open time window [start, end)."""
    return (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))
