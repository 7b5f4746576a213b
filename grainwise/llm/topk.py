"""Exact top-k by inner product: norm buckets, pruning by coordinates or by length, verified products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainwise.llm.common import ready, stored
from grainwise.llm.vectors import doubles, matrix

# Lengths of one bucket differ by this factor at most.
RATIO = 0.9
CANDIDATES, QUERIES = 8192, 2048
# From this local cosine threshold on, coordinates prune better than lengths.
STEEP = 0.3
FOCUS = 3
EXACT = 2.0**53


def scaled(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (floor(scale * x) as binary 64-bit integers), length and bucket of the vectors that take part."""
    def run(batches):
        for batch in batches:
            ids, out, lengths, buckets = [], [], [], []
            for vec, x in zip(batch.column("vec_id").to_pylist(), batch.column("x").to_pylist(), strict=True):
                if x is None or vec is None:
                    continue
                v = np.floor(scale * np.frombuffer(x))
                length = math.sqrt(float(v @ v))
                ids.append(vec)
                out.append(v.astype(np.int64).tobytes())
                lengths.append(length)
                buckets.append(math.floor(math.log(length) / -math.log(RATIO)) if length else -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(lengths, pa.float64()), pa.array(buckets, pa.int64())],
                                             names=["vec_id", "v", "length", "bucket"])
    return doubles(rows).mapInArrow(run, "vec_id bigint, v binary, length double, bucket bigint")


def top_k(rows: DataFrame, every: int = 20, k: int = 20, scale: int = 64, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` the k rows of other ids with the highest products.

    Ties go to the smaller vec_id. A vector that is NULL or holds NULL or non-finite components takes no part, nor does a
    NULL vec_id; products are between vectors of one dimension. Repeated rows are candidates of their own, but one query.

    Candidates are grouped by length into buckets, and buckets into blocks by a hash; queries into blocks likewise. Every
    query block meets every candidate block in a task of its own. The k-th best product within one block of the longest
    vectors, found first, is a query's threshold; divided by both lengths it is the local cosine threshold of a bucket,
    by which a bucket is skipped or pruned. All survivors are multiplied exactly.
    """
    ready(rows.sparkSession)
    read = stored(scaled(rows, scale), "scaled")
    # One row per bucket: lengths are doubles, so there are 14,000 of them at most.
    counts = {r["bucket"]: r["n"] for r in read.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    # A query is an id: of rows that share one, the smallest vector asks.
    chosen = read.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "length")).alias("own")).select("vec_id", "own.v", "own.length")
    n_queries = chosen.count()
    blocks = {b: -(-n // candidates) for b, n in counts.items()}
    q_blocks = max(1, -(-n_queries // queries))
    schema = "query_id bigint, vec_id bigint, score bigint"
    if not counts or not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    number = F.create_map(*[F.lit(x).cast("bigint") for b, n in sorted(blocks.items()) for x in (b, n)])
    part = F.pmod(F.xxhash64("vec_id"), number[F.col("bucket")])
    cand = read.select("vec_id", "v", "length", "bucket", part.alias("part"))
    asked = chosen.select("vec_id", "v", "length", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(q_blocks)).alias("q_block"))

    # Thresholds from one block: of the longest bucket that has enough rows.
    seed = max((b for b, n in counts.items() if n / blocks[b] > k), default=max(counts))
    seeds = _meet(asked.withColumn("at_least", F.lit(None).cast("double")), cand.filter((F.col("bucket") == seed) & (F.col("part") == 0)), {seed: 1}, q_blocks, k, schema)
    known = seeds.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("at_least"))
    ready_queries = stored(asked.join(known, "vec_id", "left"), "queries")
    best = _meet(ready_queries, cand, blocks, q_blocks, k, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cell(bucket: int):
    return lambda part: F.struct(F.lit(bucket).cast("bigint").alias("bucket"), part.cast("bigint").alias("part"))


def _meet(asked: DataFrame, cand: DataFrame, blocks: dict[int, int], q_blocks: int, k: int, schema: str) -> DataFrame:
    """The k best of every query within every block of candidates."""
    cells = [F.transform(F.sequence(F.lit(0), F.lit(n - 1)), _cell(b)) for b, n in sorted(blocks.items())]
    parts = F.explode(F.flatten(F.array(*cells)))
    left = asked.withColumn("cell", parts).select("q_block", "cell.bucket", "cell.part", "vec_id", "v", "length", "at_least")
    right = cand.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))
    # Both sides stem from one table; new names keep their columns apart.
    names = right.columns
    right = right.select([F.col(n).alias(f"c_{n}") for n in names])
    key = ["q_block", "bucket", "part"]

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.rename_columns(names)
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and c.num_rows:
            sizes = {len(v.as_py()) for v in c.column("v")} & {len(v.as_py()) for v in q.column("v")}
            for size in sorted(sizes):
                of = lambda t: t.filter(pa.array([len(v.as_py()) == size for v in t.column("v")]))  # noqa: B023, E731
                out += search(of(q), of(c), k)
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    return left.groupBy(*key).cogroup(right.groupBy(*[f"c_{k}" for k in key])).applyInArrow(run, schema)


def search(q: pa.Table, c: pa.Table, k: int) -> list[tuple[np.ndarray, ...]]:
    """One block of candidates of similar length against one block of queries."""
    lengths = np.array(c.column("length").to_pylist())
    order = np.lexsort((np.array(c.column("vec_id").to_pylist()), -lengths))
    lengths, ids, v = lengths[order], np.array(c.column("vec_id").to_pylist(), np.int64)[order], matrix(c.column("v"), np.int64)[order]
    asked = matrix(q.column("v"), np.int64)
    whole = float(np.abs(v).max(initial=0)) * float(np.abs(asked).max(initial=0)) * v.shape[1] < EXACT
    number = np.float64 if whole else np.int64
    v, asked = v.astype(number), asked.astype(number)
    unit = np.ascontiguousarray((v / np.where(lengths > 0, lengths, 1)[:, None]).T)
    out = []
    for query, x, length, floor in zip(q.column("vec_id").to_pylist(), asked, q.column("length").to_pylist(), q.column("at_least").to_pylist(), strict=True):
        some = _survivors(x, length, floor, lengths, unit)
        scores = v[some] @ x
        fit = ids[some] != query
        scores, mine = scores[fit], ids[some][fit]
        if len(scores) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            fit = scores >= edge
            scores, mine = scores[fit], mine[fit]
        best = np.lexsort((mine, -scores))[:k]
        out.append((np.full(len(best), query), mine[best], scores[best].astype(np.int64)))
    return out


def _survivors(x: np.ndarray, length: float, floor: float | None, lengths: np.ndarray, unit: np.ndarray) -> np.ndarray | slice:
    """Candidates that can reach the floor; lengths descend. A margin keeps rounding on the safe side."""
    if floor is None or length == 0 or lengths[0] == 0:
        return slice(None)
    local = floor / (length * lengths[0])
    if local > 1 + 1e-9:
        return slice(0)
    if local < STEEP:
        # Length pruning: the longest ones, as far as length alone can reach the floor.
        return slice(int(np.searchsorted(-lengths, -floor / length * (1 - 1e-9), side="right"))) if floor > 0 else slice(None)
    # Coordinate pruning: a unit vector at that cosine has each coordinate within a band around the query's.
    own = x / length
    keep = np.ones(unit.shape[1], bool)
    spread = math.sqrt(max(0.0, 1 - local * local))
    for f in np.argsort(-np.abs(own))[:FOCUS]:
        # At cosines above the threshold the band's far end is the coordinate's own bound, one.
        reach = spread * math.sqrt(max(0.0, 1 - own[f] ** 2)) + 1e-9
        if own[f] > 0:
            keep &= unit[f] >= own[f] * local - reach
            if own[f] < local:
                keep &= unit[f] <= own[f] * local + reach
        else:
            keep &= unit[f] <= own[f] * local + reach
            if -own[f] < local:
                keep &= unit[f] >= own[f] * local - reach
    return np.flatnonzero(keep)
