"""Vectors as both vector operators read them, and runs of equal keys in sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import ready


def doubles(rows: DataFrame) -> DataFrame:
    """vec_id and x: the components as binary doubles, NULL for a vector that is NULL or holds NULL or non-finite components."""
    ready(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                ok = v is not None and None not in v
                x = np.array(v, np.float64) if ok else None
                out.append(x.tobytes() if ok and len(x) and np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "x"])
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id bigint, x binary")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches sorted by them; only one run is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, key
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column, kind=np.float64) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)
