"""Exact order statistics without gathering a column into one task.

Spark's ``percentile`` is exact but merges every distinct value of a column in
one task; ``percentile_approx`` is bounded but not exact. Here the approximate
one only proposes a bracket around the wanted rank; counting passes (map-side
aggregates, at most BUCKETS rows back to the driver per rank) then shrink the
bracket until a single value is left. Each pass divides it by BUCKETS, so a
column of any size needs a handful of passes and never a shuffle of its values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions.cells import col

BUCKETS = 4096
ACCURACY = 1_000


@dataclass
class _Bracket:
    column: str
    rank: int  # zero-based
    low: float
    high: float
    below: int = 0  # how many values are smaller than low

    @property
    def open(self) -> bool:
        return self.low < self.high


def _survey(numbers: DataFrame, columns: list[str], fractions: list[float]) -> dict[str, dict]:
    """Count, extremes and approximate neighbours of each fraction, in one pass."""
    slack = 2.0 / ACCURACY
    probes = [min(1.0, max(0.0, f + d)) for f in fractions for d in (-slack, slack)]
    wanted = []
    for i, name in enumerate(columns):
        c = col(name)
        wanted += [
            F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
            F.percentile_approx(c, probes, ACCURACY).alias(f"at{i}"),
        ]
    row = numbers.agg(*wanted).first()
    return {
        name: {"n": row[f"n{i}"], "low": row[f"lo{i}"], "high": row[f"hi{i}"],
               "near": [(row[f"at{i}"][2 * k], row[f"at{i}"][2 * k + 1]) for k in range(len(fractions))]
               if row[f"n{i}"] else []}
        for i, name in enumerate(columns)
    }


def _settle(numbers: DataFrame, brackets: list[_Bracket], extremes: dict[str, dict]) -> None:
    """Count what lies below and inside each proposed bracket; widen a wrong one."""
    probes = []
    for i, b in enumerate(brackets):
        probes += [F.count_if(col(b.column) < b.low).alias(f"b{i}"), F.count_if(col(b.column) <= b.high).alias(f"u{i}")]
    row = numbers.agg(*probes).first()
    for i, b in enumerate(brackets):
        if row[f"b{i}"] <= b.rank < row[f"u{i}"]:
            b.below = row[f"b{i}"]
        else:
            b.low, b.high, b.below = extremes[b.column]["low"], extremes[b.column]["high"], 0


def _narrow(numbers: DataFrame, brackets: list[_Bracket]) -> None:
    """One histogram pass over the open brackets; only values inside them are counted."""
    slots = []
    for i, b in enumerate(brackets):
        v = col(b.column)
        # Halved operands keep the span finite for the largest doubles.
        place = F.floor((v / 2 - b.low / 2) / (b.high / 2 - b.low / 2) * BUCKETS)
        slot = F.struct(
            F.lit(i).alias("target"), F.least(place, F.lit(BUCKETS - 1)).alias("bucket"), v.alias("value")
        )
        slots.append(F.when(v.between(b.low, b.high), slot))
    histogram = (
        numbers.select(F.inline(F.array(*slots)))
        .filter(F.col("target").isNotNull())
        .groupBy("target", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    )
    for i, b in enumerate(brackets):
        seen = b.below
        for cell in sorted((r for r in histogram if r["target"] == i), key=lambda r: r["bucket"]):
            if b.rank < seen + cell["n"]:
                b.low, b.high, b.below = cell["low"], cell["high"], seen
                break
            seen += cell["n"]


def _values_at(numbers: DataFrame, brackets: list[_Bracket], extremes: dict[str, dict]) -> None:
    _settle(numbers, brackets, extremes)
    while open_ones := [b for b in brackets if b.open]:
        _narrow(numbers, open_ones)


def quantiles(
    numbers: DataFrame, columns: list[str], fractions: list[float]
) -> dict[str, tuple[int, list[float | None]]]:
    """{column: (count of values, linearly interpolated quantiles)}; NULLs are ignored."""
    if not columns:
        return {}
    survey = _survey(numbers, columns, fractions)
    found: dict[str, tuple[int, list[float | None]]] = {
        name: (0, [None] * len(fractions)) for name in columns if not survey[name]["n"]
    }
    brackets: dict[tuple[str, int], _Bracket] = {}
    for name in columns:
        n = survey[name]["n"]
        if n:
            for k, fraction in enumerate(fractions):
                low, high = survey[name]["near"][k]
                position = (n - 1) * fraction
                for rank in {math.floor(position), min(math.floor(position) + 1, n - 1)}:
                    brackets.setdefault((name, rank), _Bracket(name, rank, low, high))
    if brackets:
        _values_at(numbers, list(brackets.values()), survey)
        for name in {b.column for b in brackets.values()}:
            n = survey[name]["n"]
            values = []
            for fraction in fractions:
                position = (n - 1) * fraction
                lower = math.floor(position)
                left = brackets[(name, lower)].low
                right = brackets[(name, min(lower + 1, n - 1))].low
                values.append(left + (position - lower) * (right - left))
            found[name] = (n, values)
    return found


def nearest_rank(numbers: DataFrame, column: str, fraction: float) -> float | None:
    """Value at the 1-based rank ceil(fraction * n); NULLs are ignored."""
    survey = _survey(numbers, [column], [fraction])
    facts = survey[column]
    n = facts["n"]
    if not n:
        return None
    low, high = facts["near"][0]
    bracket = _Bracket(column, max(0, math.ceil(n * fraction) - 1), low, high)
    _values_at(numbers, [bracket], survey)
    return bracket.low
