"""What came before a row, without one task per key.

A plain window over a key sorts all rows of that key in one task. Here a key's
rows are cut into chunks (a time bucket, say). Inside a chunk a window does the
work; across chunks one summary row per (key, chunk) carries the result on. Any
state that can be summarised that way (last value, running maximum, running
sum) is exact, and a key holding a third of the table is spread over its chunks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Carry:
    """One value wanted from all earlier rows of the same key.

    ``last`` is the previous row's value (rows where ``where`` is false are
    skipped), ``max`` and ``sum`` run over all earlier rows.
    """

    name: str
    kind: str  # last, max, sum
    value: Column
    where: Column | None = None


def with_earlier(df: DataFrame, key: list[str], chunk: Column, order: list[str], carries: list[Carry]) -> DataFrame:
    """Adds one column per carry: its value over strictly earlier rows of the key.

    ``order`` must order the rows of a key totally and agree with ``chunk``
    (later chunk, later row). A row without a key or a chunk has no history and
    is part of none. The final join is on (key, chunk), the partitioning the
    inner window already made, so the rows are shuffled once.
    """
    prepared = df.withColumn("__chunk", chunk)
    placed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*key, "__chunk"]])
    for i, c in enumerate(carries):
        value = F.struct(c.value.alias("v")) if c.kind == "last" else c.value
        prepared = prepared.withColumn(f"__in{i}", value if c.where is None else F.when(c.where, value))
    inner = Window.partitionBy(*key, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[F.col(o) for o in order])

    def over(kind: str, value: Column, window) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return (F.max(value) if kind == "max" else F.sum(value)).over(window)

    within = prepared.withColumns({f"__w{i}": over(c.kind, F.col(f"__in{i}"), inner) for i, c in enumerate(carries)})
    summaries = prepared.filter(placed).groupBy(*key, "__chunk").agg(*[
        (F.max_by(F.col(f"__in{i}"), F.when(F.col(f"__in{i}").isNotNull(), place)) if c.kind == "last"
         else F.max(f"__in{i}") if c.kind == "max" else F.sum(f"__in{i}")).alias(f"__s{i}")
        for i, c in enumerate(carries)
    ])
    carried = summaries.select(
        *[F.col(k).alias(f"__k{n}") for n, k in enumerate(key)], F.col("__chunk").alias("__c"),
        *[over(c.kind, F.col(f"__s{i}"), across).alias(f"__p{i}") for i, c in enumerate(carries)],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k) == F.col(f"__k{n}") for n, k in enumerate(key)] + [F.col("__chunk") == F.col("__c")],
    )
    out = []
    for i, c in enumerate(carries):
        w, p = F.when(placed, F.col(f"__w{i}")), F.col(f"__p{i}")
        if c.kind == "last":
            out.append(F.coalesce(w, p)["v"].alias(c.name))
        elif c.kind == "max":
            out.append(F.greatest(w, p).alias(c.name))
        else:
            out.append(F.when(w.isNull(), p).when(p.isNull(), w).otherwise(w + p).alias(c.name))
    return within.join(carried, same, "left").select(*[F.col(n) for n in df.columns], *out)
