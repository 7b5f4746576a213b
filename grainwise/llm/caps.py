"""Near copies of vectors: spherical-cap filters from structured random product codes, list-decoded, joined and verified."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import components, ready, stored
from grainwise.llm.vectors import doubles, runs

PARTS = 2
# Independent codes, and centres per part of each. The pairs of centres are the filter directions; a vector enters those whose
# inner product is ALPHA / sqrt(dim) or more, and at least its LEAST nearest ones of each code. Measured on random pairs at
# a cosine of 0.9, all of 3,000 shared a filter.
CODES = 2
CENTRES = 128
ALPHA = 3.2
LEAST = 10
BLOCK = 1000
SEED = 90


def code(dim: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Of each code a random rotation and, per part of the rotated coordinates, random directions.

    A centre of a part is scaled so that a combination of centres has length one. The same for everybody, by its seed.
    """
    out = []
    for k in range(CODES):
        rng = np.random.default_rng([SEED, dim, k])
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts = []
        for piece in np.array_split(np.arange(dim), PARTS):
            c = rng.standard_normal((CENTRES, len(piece)))
            length = np.linalg.norm(c, axis=1, keepdims=True)
            parts.append(c / np.where(length > 0, length, 1) / math.sqrt(PARTS))
        out.append((turn, parts))
    return out


def filters(x: np.ndarray, own: list) -> list[np.ndarray]:
    """For each row all filters whose cap it lies in, ascending.

    List decoding: the second part's products are sorted, so for each centre of the first part the centres that lift the
    sum over the bound are a tail of that list; no other combination is looked at. A row with fewer than LEAST of them gets a
    lower bound.
    """
    out: list[list[np.ndarray]] = [[] for _ in x]
    for k, (turn, parts) in enumerate(own):
        unit, at, scores = x @ turn / np.linalg.norm(x, axis=1, keepdims=True), 0, []
        for c in parts:
            scores.append(unit[:, at: at + c.shape[1]] @ c.T)
            at += c.shape[1]
        for row, first, second in zip(out, *scores, strict=True):
            order = np.argsort(second)
            ranked, bound = second[order], ALPHA
            while True:
                begin = np.searchsorted(ranked, bound / math.sqrt(x.shape[1]) - first)
                if int((CENTRES - begin).sum()) >= LEAST:
                    break
                bound -= 0.2
            row += [(k * CENTRES + i) * CENTRES + order[begin[i]:] for i in np.flatnonzero(begin < CENTRES).tolist()]
    return [np.unique(np.concatenate(row)) for row in out]


def _narrow(x: bytes) -> bytes:
    """Doubles as floats where that loses nothing; the first byte says which."""
    wide = np.frombuffer(x)
    with np.errstate(over="ignore"):
        small = wide.astype(np.float32)
    return b"f" + small.tobytes() if (small == wide).all() else b"d" + x


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.float32 if x[:1] == b"f" else np.float64, offset=1).astype(np.float64)


def near_copies(rows: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors of one dimension are linked if their cosine in double precision is at least ``cosine``. Vectors that are NULL,
    empty, zero or hold NULL or non-finite components are linked with nothing, and so is a NULL vec_id, which has no
    component and is kept. Rows with one vec_id and one vector are one vector; n_links counts other vectors.

    Equal vectors are one class. A class goes to the cells of its filters; a filter with more than ``block`` classes is cut into
    blocks and every pair of its blocks is a cell, so no task holds a hot filter. A cell compares its vectors exactly, counts each
    pair only in the smallest filter both lie in, and returns counts and at most one connecting link per vector.
    """
    ready(rows.sparkSession)
    spark = rows.sparkSession

    def key(batches):
        for batch in batches:
            keys = [None if x is None or not np.frombuffer(x).any() else hashlib.blake2b((np.frombuffer(x) + 0.0).tobytes(), digest_size=16).digest() for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["vec_id", "x", "key"])

    read = stored(doubles(rows).mapInArrow(key, "vec_id bigint, x binary, `key` binary"), "vectors")
    good = read.filter("vec_id IS NOT NULL AND key IS NOT NULL")
    classes = stored(good.select("vec_id", "key", "x").groupBy("key", "vec_id").agg(F.first("x").alias("x")).groupBy("key")
                     .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")), "vector-classes")

    def decode(batches):
        codes: dict[int, tuple] = {}
        for batch in batches:
            xs = batch.column("x").to_pylist()
            found: list = [None] * len(xs)
            for size in {len(x) for x in xs}:
                mine = [i for i, x in enumerate(xs) if len(x) == size]
                if size not in codes:
                    codes[size] = code(size // 8)
                table = np.frombuffer(b"".join(xs[i] for i in mine)).reshape(len(mine), -1)
                scale = np.abs(table).max(axis=1, keepdims=True)
                for i, f in zip(mine, filters(table / scale, codes[size]), strict=True):
                    # Filters of another dimension are other filters.
                    found[i] = (f + (size // 8) * CODES * CENTRES**PARTS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array([_narrow(x) for x in xs], pa.binary()), pa.array(found, pa.list_(pa.int64())),
                                              pa.array([f.astype("<u4").tobytes() if f[-1] < 1 << 32 else f.tobytes() for f in found], pa.binary())], names=["rep", "copies", "x", "caps", "packed"])

    coded = stored(classes.select("rep", "copies", "x").mapInArrow(decode, "rep bigint, copies bigint, x binary, caps array<bigint>, packed binary"), "caps")
    # Filters of a single class link nothing; large ones are cut into blocks.
    sizes = stored(coded.select(F.explode("caps").alias("cap")).groupBy("cap").agg(F.count("*").alias("n")).filter("n > 1")
                   .select("cap", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cap-sizes")
    entered = (coded.withColumn("cap", F.explode("caps")).join(sizes, "cap")
               .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("cap", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "x", "packed"))
    cells = entered.repartition(max(_partitions(spark), 1), "cap", "i", "j").sortWithinPartitions("cap", "i", "j", "rep")

    def compare(batches):
        for cell in runs(batches, ["cap", "i", "j"]):
            found = _compare(cell, cosine)
            if found is not None:
                yield found

    found = stored(cells.mapInArrow(compare, "rep bigint, links bigint, least bigint"), "vector-links")
    counts = found.groupBy(F.col("rep").alias("id")).agg(F.sum("links").alias("links"))
    links = found.select(F.col("rep").alias("a"), F.col("least").alias("b")).filter("a <> b")
    twice = good.groupBy("vec_id").agg(F.countDistinct("key").alias("n")).filter("n > 1").select("vec_id")
    same = good.join(twice, "vec_id").select("vec_id", "key").join(classes.select("key", "rep"), "key").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    roots = stored(components(links.union(same), "vector-roots"), "vector-roots")
    named = stored(classes.select("key", "rep", "copies").join(counts, F.col("rep") == F.col("id"), "left").drop("id")
                   .join(roots, F.col("rep") == F.col("id"), "left")
                   .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named-vectors")
    known = F.col("vec_id").isNotNull()
    return (read.select("vec_id", "key").join(named, "key", "left")
            .select("vec_id", F.when(known & F.col("n_links").isNotNull(), F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
                    F.when(known, F.coalesce("root", "vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _compare(cell: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """(rep, copies of its links that this cell counts, smallest id it hangs together with) of the vectors with links."""
    cap, i, j = (cell.column(k)[0].as_py() for k in ("cap", "i", "j"))
    x = np.stack([_wide(v) for v in cell.column("x").to_pylist()])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    near = x @ x.T / np.outer(*[np.sqrt((x * x).sum(axis=1))] * 2) >= cosine
    np.fill_diagonal(near, False)
    if i != j:
        own = np.array(cell.column("own").to_pylist())
        near &= own[:, None] != own[None, :]
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return None
    near = near[np.ix_(some, some)]
    reps = np.array(cell.column("rep").to_pylist(), np.int64)[some]
    copies = np.array(cell.column("copies").to_pylist(), np.int64)[some]
    packed = cell.column("packed")
    caps = [np.frombuffer(packed[k].as_py(), "<u4" if cap < 1 << 32 else "<i8").tolist() for k in some.tolist()]
    # Of several shared filters the smallest counts the pair.
    lower = sorted({c for mine in caps for c in mine if c < cap})
    place = {c: k for k, c in enumerate(lower)}
    member = np.zeros((len(some), max(1, len(lower))), np.float32)
    for k, mine in enumerate(caps):
        member[k, [place[c] for c in mine if c < cap]] = 1
    counted = near & (member @ member.T == 0)
    label = reps.copy()
    while True:
        low = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == label).all():
            break
        label = low
    return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(counted @ copies), pa.array(label)], names=["rep", "links", "least"])
