"""A table as a stream: its parts arrive one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from grainwise.session import scratch_path


def in_parts(table: DataFrame, part: Column, parts: int, start: Callable[[DataFrame, str], StreamingQuery]) -> None:
    """Runs a stream over the rows of part 0, stops it, resumes it over those of part 1, and so on.

    ``start`` gets the stream of rows and the checkpoint folder; it starts a query that ends with the rows at hand.
    """
    source, checkpoint = scratch_path(table.sparkSession, "stream"), scratch_path(table.sparkSession, "checkpoint")
    for i in range(parts):
        table.filter(part == i).write.mode("append").parquet(source)
        query = start(table.sparkSession.readStream.schema(table.schema).parquet(source), checkpoint)
        query.awaitTermination()


def collected(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that stores every micro-batch under its number, so a retry overwrites itself."""
    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return sink
