"""What the operators of this package share: scratch tables, passes over texts, word hashes, components, a small regression."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.session import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])
ROWS_PER_BATCH = 1000


def ready(spark: SparkSession) -> None:
    """Workers import this package; texts may be long, so an Arrow batch holds fewer rows than Spark's default."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{paths}" if paths else ROOT
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, of: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``of``. A NULL id has no fold."""
    return F.crc32(doc_id.cast("string")) % of


def per_text(docs: DataFrame, make: Callable[[], Callable], schema: str, keep: tuple[str, ...] = ("doc_id",), raw: bool = False) -> DataFrame:
    """One row out per row in: the ``keep`` columns and what the function gives for the text.

    ``make()`` runs once per task and returns a function from a text (bytes if ``raw``; a NULL text is empty) to a
    tuple in the order of ``schema``. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    out = docs.sparkSession.createDataFrame([], schema).schema
    ready(docs.sparkSession)
    kinds = pa.schema([_arrow(f) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, empty = make(), b"" if raw else ""
        for batch in batches:
            texts = batch.column("text")
            found = [work(t or empty) for t in (texts.cast(pa.binary()) if raw else texts).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)],
                names=[*keep, *kinds.names])

    source = docs.select(*[F.col(k).cast("string").alias(k) if k == "text" else F.col(k) for k in dict.fromkeys((*keep, "text"))])
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*source.select(*keep).schema.fields, *out.fields])
    return source.mapInArrow(run, full)


def _arrow(field) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(field.name, to_arrow_type(field.dataType))


# Word hashes -------------------------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)])


SLICE = 1 << 20
_UP = _powers(_BASE, SLICE)
_DOWN = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), SLICE)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every blank-separated word, A-Z lower-cased, in order.

    Polynomial prefix sums over slices that end at a blank; a word longer than a slice gets slices of its own that are
    chained. Equal words have equal hashes; two of n different words collide with probability about n*n / 2**65.
    """
    if len(text) <= SLICE:
        return _slice_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            piece = np.frombuffer(text, np.uint8, end - at, at)
            blanks = np.flatnonzero(_BLANK[piece])
            if not len(blanks):  # no blank in a whole slice: one very long word, which is hashed in one go
                stop = next((i for i in range(end, len(text)) if _BLANK[text[i]]), len(text))
                import hashlib
                parts.append(np.frombuffer(hashlib.blake2b(text[at:stop].lower(), digest_size=8).digest(), np.uint64))
                at = stop
                continue
            end = at + int(blanks[-1]) + 1
        parts.append(_slice_hashes(text[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _slice_hashes(text: bytes) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[_FOLD[raw]] * _UP[: len(raw)], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = mixed(h * _BASE + words[i: len(words) - n + 1 + i])
    return np.unique(h)


# Components --------------------------------------------------------------------------------------------------------

def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) for every end of the edges (a, b): the smallest id that its links reach.

    Rounds of large-star and small-star steps: each keeps the components and has at most as many edges as the one before.
    A node with very many links is one aggregation key; the smallest neighbours are tables of their own, so the
    joins with them can be split where they are skewed. Every round ends in a table in the shared folder.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = stored(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        now = stored(large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
                     .filter("a <> b").distinct(), name)
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == before:
            break
        before = total
    roots = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


# Regression --------------------------------------------------------------------------------------------------------

def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (intercept first) of a ridge logistic regression by Newton steps; y may be a probability."""
    x = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, x.shape[1] + 1))
    w = np.ones(len(x)) if weight is None else weight
    beta, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p) + 1e-9)) @ x + np.diag(keep), x.T @ (w * (y - p)) - keep * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def chance(beta: np.ndarray, *features: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, beta[0] + sum(b * f for b, f in zip(beta[1:], features, strict=True))))))


def fitting_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, name: str) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out fold, stored.

    The rows are those with the smallest hashes of their ids, so the sample is the same wherever it is drawn. Its size is
    the bound that makes the broadcast safe; scoring never depends on it.
    """
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().filter(remainder(F.col("doc_id"), 5) != 0)
             .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").dropna(), name)
