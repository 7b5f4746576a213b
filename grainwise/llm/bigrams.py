"""The hierarchical Pitman-Yor model of ``hpy`` with one context restaurant for every word that occurs before another.

All context restaurants share the root restaurant, whose base is the spelling model of ``hpy``. Nothing that grows with the corpus
is collected: only totals of the root and the spelling model, which is bounded by its alphabet, reach the driver.

A word belongs to a bucket by its hash and a bucket to one of ``side`` groups. The bucket ranks its words by how often they occur; ranks and
buckets make up the word's number in its group, so numbers of frequent words are small. A pair is a word with the word before it.
A cell holds the pairs of two groups, so those of a common word, be it the first or the second of a pair, lie in ``side`` cells.
There are about as many cells as partitions of the input, so numbers in a group grow as the root of the input.

A sweep draws the tables of every dish from their exact conditional distribution as in ``hpy``: given the rates at which contexts
open tables and the weights of the words in the root, all dishes are independent. Cells draw the tables of their pairs and send
sums by context and by word to the buckets; these seat the root, draw rates and weights anew and send them to the cells that ask. A
dish with one customer has one table in every state, so it is counted once and only other dishes are drawn. Nobody keeps a
seating: the tables of a sample follow from the rates and weights before it, which are stored, and the seed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm import hpy
from grainwise.llm import tables as seats_of
from grainwise.llm.hpy import BURN_IN, CONTEXT_D, CONTEXT_S, ROOT_D, ROOT_S, SAMPLES, SEED, UNIT
from grainwise.session import shared_folder

# Kinds of rows: places of the pairs of a block in their cell, dishes of a cell, what a cell has of the words of a bucket (types and those with
# one customer; which it asks for; sums of tables), tables by word and what buckets send to cells.
PLACES, DISHES, TYPES, ASKS, SUMS, STATE, SENT = range(7)
# What a row between a cell and a bucket is about: contexts, or words in the root.
BEFORE, WORD = range(2)
_FIELDS = "kind int, cell int, bucket int, role int, block bigint, parts array<binary>"
_SCHEMA = pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("bucket", pa.int32()), ("role", pa.int32()), ("block", pa.int64()), ("parts", pa.list_(pa.binary()))])
# Numbers of the words of a group are kept in 32 bits.
MOST_WORDS = 1 << 32
LOW = MOST_WORDS - 1
# Pairs whose probabilities are taken at once; slices, at most, in which the pairs of a block or of a cell are sorted.
PAIRS_AT_ONCE, SLICES = 1 << 18, 8


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _put(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers, byte by byte, so that the high bytes, mostly zero, stand together."""
    raw = np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(len(numbers), np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _got(data: bytes, kind: str = "<u4") -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()
    return values.astype(np.float64 if "f" in kind else np.int64)


def _steps(rising: np.ndarray) -> bytes:
    return _put(np.diff(rising, prepend=0))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_got(data))


def _grouped(batches, key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that arrive sorted by a key, by that key."""
    now, rows = None, []
    for row in hpy._rows(batches):
        if rows and row[key] != now:
            yield now, rows
            rows = []
        now = row[key]
        rows.append(row)
    if rows:
        yield now, rows


def _cut(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of every one of the sorted keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False):
        yield int(keys[a]), values[a:b]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and which of these every key is; takes half the memory of ``np.unique``."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


@dataclass(frozen=True)
class Net:
    """How words are dealt to buckets, buckets to groups, and pairs to cells."""
    buckets: int

    @property
    def parts(self) -> int:
        return max(1, self.buckets // hpy.BUCKETS_PER_PART)

    @property
    def side(self) -> int:
        return math.isqrt(self.parts)

    @property
    def per_group(self) -> int:
        return -(-self.buckets // self.side)

    def number(self, bucket: int, rank: np.ndarray) -> np.ndarray:
        """Of words in the group of their bucket."""
        return rank * self.per_group + bucket // self.side

    def ranks(self, numbers: np.ndarray) -> np.ndarray:
        return numbers // self.per_group

    def groups(self, cell: int) -> tuple[int, int]:
        """Of the words before and the words."""
        return divmod(cell, self.side)

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows of a key side by side, in as many partitions as the input has at least."""
        few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) < self.parts
        return (rows.repartition(self.parts, key) if few else rows.repartition(key)).sortWithinPartitions(key)

    def by_bucket(self, group: int, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets, and which of the words of a group with these (rising) numbers they have, in the order of their ranks."""
        bucket = numbers % self.per_group * self.side + group
        order = np.argsort(bucket, kind="stable")
        yield from _cut(bucket[order], order)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, by kind; Spark may delete what it shuffled for them once they are written."""
    spark, path, clean = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        rows.write.partitionBy(*[k for k in ("kind",) if k in rows.columns]).parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(rows.schema).parquet(path)


def _of(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.filter(F.col("kind").isin(*kinds)).select("kind", "cell", "bucket", "role", "block", "parts")


# Words -------------------------------------------------------------------------------------------------------------

def ranked(vocabulary: DataFrame, net: Net) -> DataFrame:
    """bucket, word, counts (64-bit) of the training words, most frequent first: one row per bucket."""
    def run(batches):
        for row in hpy._rows(batches):
            words, counts = row["word"].split(b" "), np.frombuffer(row["counts"], "<u8").astype(np.int64)
            if net.number(row["bucket"], len(words)) > MOST_WORDS:
                raise OverflowError(f"{len(words)} words in a bucket, {net.per_group} buckets in a group")
            order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
            yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), *[pa.array([v], pa.binary()) for v in (b" ".join([words[i] for i in order]), _put(counts[order], "<u8"))]],
                                             names=["bucket", "word", "counts"])

    return vocabulary.mapInArrow(run, "bucket int, word binary, counts binary")


def numbered(rows: DataFrame, owners: DataFrame, letters: hpy.Spelling, net: Net) -> DataFrame:
    """block, bucket, pos, rank (0 for a word without training, else rank + 1), spelled (log10, of the former) of the words of every block."""
    asked = rows.filter("word IS NOT NULL").select("bucket", "block", "word", "pos")
    known = owners.select("bucket", F.lit(None).cast("bigint").alias("block"), "word", F.lit(None).cast("binary").alias("pos"))

    def run(batches):
        table = letters.table()
        for bucket, group in _grouped(batches, "bucket"):
            at = {w: i for row in group if row["block"] is None for i, w in enumerate(row["word"].split(b" "), 1)}
            for row in group:
                if row["block"] is not None:
                    words = row["word"].split(b" ")
                    rank = np.array([at.get(w, 0) for w in words], np.int64)
                    new = [words[i] for i in np.flatnonzero(rank == 0).tolist()]
                    values = (_steps(np.frombuffer(row["pos"], "<u4").astype(np.int64)), _put(rank), _put(hpy.spelled(new, table) if new else np.zeros(0), "<f4"))
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([bucket], pa.int32()), *[pa.array([v], pa.binary()) for v in values]],
                                                     names=["block", "bucket", "pos", "rank", "spelled"])

    return net.dealt(known.unionByName(asked), "bucket").mapInArrow(run, "block bigint, bucket int, pos binary, rank binary, spelled binary")


# Pairs -------------------------------------------------------------------------------------------------------------

class Block:
    """Pairs of a block: its words sorted by their numbers, and cells from these."""

    def __init__(self, words: list[tuple[int, np.ndarray, np.ndarray]], net: Net):
        """``words``: by bucket, places in the block and ranks from 1 on, 0 where there is no training."""
        total = sum(len(pos) for _, pos, _ in words)
        # Numbers of 16 bits are sorted in one pass.
        self.number, self.group, self.side = np.full(total, -1, np.int64), np.zeros(total, np.uint16 if net.side < 256 else np.int64), net.side
        for bucket, pos, rank in words:
            self.number[pos], self.group[pos] = np.where(rank > 0, net.number(bucket, rank - 1), -1), bucket % net.side
        self.order = np.argsort(self.number, kind="stable").astype(np.int32)
        self.place = np.empty(total, np.int32)
        self.place[self.order] = np.arange(total)

    def pairs(self, chunks: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens whose words before are in the same groups, and their pairs: the word before and the word, by their places in the order of numbers."""
        # Whole texts, each closed by an end token, so that one stands before the first word of every text.
        x = np.concatenate([self.place[:1], *[self.place[hpy._unsqueezed(row["data"])] for row in chunks]])
        many = min(self.side, SLICES)
        part = (self.group * np.int64(many) // self.side).astype(np.uint8)[self.order][x[:-1]]
        for i in range(many):
            at = np.flatnonzero(part == i)
            yield at, (x[at].astype(np.int64) << 31) | x[at + 1]

    def words_of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.order[pairs >> 31], self.order[pairs & ((1 << 31) - 1)]

    def cells(self, before: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Cells, and which of the distinct, sorted pairs they have, where both words are known."""
        cell, none = self.group[before] * self.side + self.group[word], self.side * self.side
        known = self.number >= 0
        cell[~(known[before] & known[word])] = none
        by = np.argsort(cell, kind="stable")
        for key, at in _cut(cell[by], by):
            if key != none:
                yield key, at


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.filter("word IS NULL").select("block", "docs", "data")


def pairs(rows: DataFrame, numbers: DataFrame, net: Net) -> DataFrame:
    """Rows with the distinct pairs of a block in a cell, sorted, and how often documents that are not held out have them.

    The pairs are of words that training has; those that only held-out documents have are there too, as they have to be looked up.
    """
    named = numbers.select("block", F.lit(None).cast(rows.schema["docs"].dataType).alias("docs"), F.lit(None).cast("binary").alias("data"), "bucket", "pos", "rank")
    both = net.dealt(named.unionByName(_chunks(rows), allowMissingColumns=True), "block")

    def run(batches):
        for block, group in _grouped(batches, "block"):
            chunks = [row for row in group if row["docs"] is not None]
            b = Block([(row["bucket"], _risen(row["pos"]), _got(row["rank"])) for row in group if row["docs"] is None], net)
            docs = [d for row in chunks for d in row["docs"]]
            held = np.repeat([d["held"] for d in docs], [d["n"] for d in docs])
            for of, found in b.pairs(chunks):
                kinds, counts = np.unique((found << 1) | held[of], return_counts=True)
                first = np.flatnonzero(np.diff(kinds >> 1, prepend=-1))
                counts = np.add.reduceat(np.where(kinds & 1, 0, counts), first) if len(first) else counts
                before, word = b.words_of(kinds[first] >> 1)
                for cell, at in b.cells(before, word):
                    contexts, sizes = np.unique(b.number[before[at]], return_counts=True)
                    words, index = np.unique(b.number[word[at]], return_inverse=True)
                    yield _row(kind=PLACES, cell=cell, block=block, parts=[_steps(contexts), _put(sizes), _steps(words), _put(index), _put(counts[at])])

    return both.mapInArrow(run, _FIELDS)


def met(found: DataFrame, net: Net) -> DataFrame:
    """Counts of all blocks summed up, by cell.

    PLACES: for the pairs of a block, 0 if no training has them, 1 if it has them once, else 1 + the step to the next dish. DISHES: contexts,
    words, dishes by context, words of the dishes, counts. TYPES and ASKS: ranks of contexts or words of a bucket.
    """
    def run(batches):
        for cell, group in _grouped(batches, "cell"):
            yield from _met(cell, group, net)

    return net.dealt(found, "cell").mapInArrow(run, _FIELDS)


def _met(cell: int, rows: list[dict], net: Net) -> Iterator[pa.RecordBatch]:
    keys, counts = [], []
    for row in rows:
        contexts, sizes, words, index, n = row["parts"]
        keys.append((np.repeat(_risen(contexts), _got(sizes)).astype(np.uint64) << np.uint64(32)) | _risen(words)[_got(index)].astype(np.uint64))
        counts.append(_got(n).astype(np.uint32))
    longest = max(keys, key=len)
    cuts = longest[np.arange(1, SLICES) * len(longest) // SLICES]
    edges = [[0, *np.searchsorted(k, cuts).tolist(), len(k)] for k in keys]
    codes, kinds, totals, dishes = [np.empty(len(k), np.int32) for k in keys], [], [], 0
    for i in range(SLICES):
        parts = [slice(*e[i: i + 2]) for e in edges]
        some, place = _distinct(np.concatenate([k[p] for k, p in zip(keys, parts, strict=True)]))
        total = np.zeros(len(some), np.int64)
        np.add.at(total, place, np.concatenate([n[p] for n, p in zip(counts, parts, strict=True)]))
        code, many = np.minimum(total, 1).astype(np.int32), np.flatnonzero(total > 1)
        code[many] = 2 + dishes + np.arange(len(many))
        dishes, at = dishes + len(many), 0
        for mine, part in zip(codes, parts, strict=True):
            mine[part] = code[place[at: at + part.stop - part.start]]
            at += part.stop - part.start
        kinds.append(some[total > 0])
        totals.append(total[total > 0])
    del keys, counts
    for row, steps in zip(rows, codes, strict=True):
        steps[steps > 1] = np.diff(steps[steps > 1], prepend=1) + 1
        yield _row(kind=PLACES, cell=cell, block=row["block"], parts=[_put(steps)])
    del codes
    kinds, total = np.concatenate(kinds), np.concatenate(totals)
    before, word = (kinds >> np.uint64(32)).astype(np.int64), (kinds & np.uint64(LOW)).astype(np.int64)
    del kinds, totals
    for role, group, of in zip((BEFORE, WORD), net.groups(cell), (before, word), strict=True):
        numbers, index = _distinct(of)
        types, ones = np.bincount(index, minlength=len(numbers)), np.bincount(index[total == 1], minlength=len(numbers))
        for bucket, at in net.by_bucket(group, numbers):
            yield _row(kind=TYPES, cell=cell, bucket=bucket, role=role, parts=[_steps(net.ranks(numbers[at])), _put(types[at]), _put(ones[at])])
            asks = at[types[at] > ones[at]]
            if len(asks):
                yield _row(kind=ASKS, cell=cell, bucket=bucket, role=role, parts=[_steps(net.ranks(numbers[asks]))])
    if dishes:
        many = total > 1
        contexts, sizes = np.unique(before[many], return_counts=True)
        words, index = _distinct(word[many])
        yield _row(kind=DISHES, cell=cell, parts=[_steps(contexts), _steps(words), _put(sizes), _put(index), _put(total[many], "<u8")])


# Seating -----------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Root:
    """Of one state: customers, tables and the weight of the whole root."""
    customers: int
    tables: int
    weight: float

    def rate(self, sweep: int) -> float:
        """The rate at which the root opens tables in the sweep that follows this state; the same in every task."""
        return float(np.random.default_rng([SEED, sweep, 1 << 40]).standard_gamma(ROOT_S / ROOT_D + self.tables))

    def pull(self) -> float:
        return (ROOT_S + ROOT_D * self.tables) / (ROOT_S + self.customers)


class Dishes:
    """The dishes of a cell with two customers or more."""

    def __init__(self, cell: int, parts: list[bytes], net: Net):
        self.cell, self.net = cell, net
        self.contexts, self.words = _risen(parts[0]), _risen(parts[1])
        self.before, self.word, self.n = np.repeat(np.arange(len(self.contexts)), _got(parts[2])), _got(parts[3]), _got(parts[4], "<u8")

    def tables(self, sent: list[dict], sweep: int, weight: float) -> np.ndarray:
        """Tables of the dishes in a sweep, from what the buckets sent in the state before, whose root has this weight."""
        by = {(row["role"], row["bucket"]): row["parts"][0] for row in sent}
        logs = []
        for role, group, numbers in zip((BEFORE, WORD), self.net.groups(self.cell), (self.contexts, self.words), strict=True):
            values = np.empty(len(numbers))
            for bucket, at in self.net.by_bucket(group, numbers):
                values[at] = _got(by[role, bucket], "<f4")
            logs.append(values)
        rng = np.random.default_rng([SEED, sweep, self.cell, 1])
        return seats_of.drawn(self.n, logs[BEFORE][self.before] + logs[WORD][self.word] - math.log(weight), CONTEXT_D, rng)

    def sums(self, tables: np.ndarray) -> Iterator[pa.RecordBatch]:
        for role, group, numbers, of in zip((BEFORE, WORD), self.net.groups(self.cell), (self.contexts, self.words), (self.before, self.word), strict=True):
            total = np.bincount(of, weights=tables, minlength=len(numbers)).astype(np.int64)
            for bucket, at in self.net.by_bucket(group, numbers):
                yield _row(kind=SUMS, cell=self.cell, bucket=bucket, role=role, parts=[_put(total[at], "<u8")])


def drawn(cells: DataFrame, sent: DataFrame, sweep: int, weight: float, net: Net) -> DataFrame:
    """Sums of the tables of a sweep by context and by word, from the cells to the buckets."""
    def run(batches):
        for cell, group in _grouped(batches, "cell"):
            dishes = Dishes(cell, next(row["parts"] for row in group if row["kind"] == DISHES), net)
            yield from dishes.sums(dishes.tables([row for row in group if row["kind"] == SENT], sweep, weight))

    return net.dealt(cells.unionByName(sent), "cell").mapInArrow(run, _FIELDS)


def seated(arrived: np.ndarray, log_base: np.ndarray, tables: np.ndarray, rate: float | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a bucket: tables in the root, their weight there, that with what may come, and rates of their contexts.

    ``arrived`` are customers in the root, ``tables`` those of the context restaurant of each word; ``rate`` is that of the root, none in the first state.
    """
    base = np.exp(log_base)
    if rate is None:
        root_tables, coming = hpy.seated(arrived, ROOT_S * base, ROOT_D, rng), 0.0
    else:
        root_tables = seats_of.drawn(arrived, math.log(rate) + log_base, ROOT_D, rng)
        coming = seats_of.rest(rate * base, ROOT_D, rng)
    sat = rng.standard_gamma(arrived - ROOT_D * root_tables)
    return root_tables, sat, sat + coming, rng.standard_gamma(CONTEXT_S / CONTEXT_D + tables)


def state(owners: DataFrame, rows: DataFrame, letters: hpy.Spelling, sweep: int, rate: float | None, net: Net) -> DataFrame:
    """STATE of every bucket after a sweep (tables by context; customers and tables of the root by word; their sums), and what it sends to cells.

    ``rows`` are TYPES and ASKS and, but for the first state, SUMS. ``rate`` is that of the root, none in the first state, which has one table per type.
    """
    words = owners.select(*[F.lit(None).cast(t).alias(n) for n, t in (("kind", "int"), ("cell", "int"))], "bucket", F.lit(None).cast("int").alias("role"),
                          F.lit(None).cast("bigint").alias("block"), F.array("word").alias("parts"))

    def run(batches):
        table = letters.table()
        for bucket, group in _grouped(batches, "bucket"):
            yield from _state(bucket, group, table, sweep, rate)

    return net.dealt(words.unionByName(rows), "bucket").mapInArrow(run, _FIELDS)


def _state(bucket: int, rows: list[dict], table: np.ndarray, sweep: int, rate: float | None) -> Iterator[pa.RecordBatch]:
    words = next(row["parts"][0] for row in rows if row["kind"] is None).split(b" ")
    totals, asks = np.zeros((2, len(words)), np.int64), {(row["cell"], row["role"]): _risen(row["parts"][0]) for row in rows if row["kind"] == ASKS}
    for row in rows:
        if row["kind"] == TYPES:
            ranks, types, ones = row["parts"]
            totals[row["role"], _risen(ranks)] += _got(types if rate is None else ones)
        elif row["kind"] == SUMS:
            totals[row["role"], asks[row["cell"], row["role"]]] += _got(row["parts"][0], "<u8")
    log_base, rng = math.log(10.0) * hpy.spelled(words, table), np.random.default_rng([SEED, sweep, bucket])
    root_tables, sat, weights, rates = seated(totals[WORD], log_base, totals[BEFORE], rate, rng)
    sums = np.array([totals[WORD].sum(), root_tables.sum(), round(float(sat.sum()) * UNIT)])
    yield _row(kind=STATE, bucket=bucket, block=sweep, parts=[_put(np.concatenate([totals[BEFORE], totals[WORD], root_tables]), "<u8"), _put(sums, "<u8")])
    logs = np.log(rates), np.log(np.maximum(weights, 1e-300))
    for (cell, role), ranks in asks.items():
        yield _row(kind=SENT, cell=cell, bucket=bucket, role=role, block=sweep, parts=[_put(logs[role][ranks], "<f4")])


def _root(rows: DataFrame, sweep: int) -> Root:
    """Totals of a state; the root's weight is that of its tables and of all that it has not seated."""
    def run(batches):
        sums = np.zeros(3, np.int64)
        for row in hpy._rows(batches):
            sums += _got(row["parts"][1], "<u8")
        yield pa.RecordBatch.from_arrays([pa.array(sums[i: i + 1]) for i in range(3)], names=["customers", "tables", "weight"])

    names = ("customers", "tables", "weight")
    total = _of(rows, STATE).mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first()
    return root_of(*total, sweep)


def root_of(customers: int, tables: int, weight: int, sweep: int) -> Root:
    unseated = np.random.default_rng([SEED, sweep, 1 << 41]).standard_gamma(ROOT_S + ROOT_D * tables)
    return Root(customers, tables, weight / UNIT + float(unseated))


@dataclass(frozen=True)
class Model:
    """owners: the training words by bucket; numbers: those of the words of every block; cells: pairs; states, in order, with the totals of their roots.

    The last states, ``samples`` of them, count.
    """
    net: Net
    owners: DataFrame
    spelling: hpy.Spelling
    numbers: DataFrame
    cells: DataFrame
    states: tuple[DataFrame, ...]
    roots: tuple[Root, ...]
    burn_in: int
    tokens: int
    distinct: int

    @property
    def samples(self) -> range:
        return range(self.burn_in + 1, len(self.states))


def learn(rows: DataFrame, net: Net, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Gibbs sweeps over the pairs of ``hpy.blocks`` that training has; after the burn-in every state is a sample."""
    owners = _stored(ranked(hpy.vocabulary(rows.filter("word IS NOT NULL")), net), "words")
    letters = hpy.spelling(owners)
    numbers = _stored(numbered(rows, owners, letters, net), "numbers")
    cells = _stored(met(pairs(rows, numbers, net), net), "cells")
    states, roots = [_stored(state(owners, _of(cells, TYPES, ASKS), letters, 0, None, net), "state")], []
    roots.append(_root(states[0], 0))
    for sweep in range(1, burn_in + samples + 1):
        sums = drawn(_of(cells, DISHES), _of(states[-1], SENT), sweep, roots[-1].weight, net)
        states.append(_stored(state(owners, _of(cells, TYPES, ASKS).unionByName(sums), letters, sweep, roots[-1].rate(sweep), net), "state"))
        roots.append(_root(states[-1], sweep))

    def run(batches):
        sums = np.zeros(2, np.int64)
        for row in hpy._rows(batches):
            counts = _got(row["counts"], "<u8")
            sums += int(counts.sum()), len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(sums[:1]), pa.array(sums[1:])], names=["tokens", "words"])

    tokens, distinct = owners.select("counts").mapInArrow(run, "tokens bigint, words bigint").agg(F.sum("tokens"), F.sum("words")).first()
    return Model(net, owners, letters, numbers, cells, tuple(states), tuple(roots), burn_in, int(tokens or 0), int(distinct or 0))


# Scores ------------------------------------------------------------------------------------------------------------

_FOUND = "block bigint, cell int, bucket int, parts array<binary>"
_FOUND_SCHEMA = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("bucket", pa.int32()), ("parts", pa.list_(pa.binary()))])


def _found(block: int, cell: int | None, bucket: int | None, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((block, cell, bucket, parts), _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)


def _found_words(model: Model) -> DataFrame:
    """Of the words of a block in a bucket: places, ranks, log10 of the spelling; counts, and by sample tables of their contexts, and customers and tables in the root."""
    nothing = {"block": "bigint", "pos": "binary", "rank": "binary", "spelled": "binary", "word": "binary", "counts": "binary", "parts": "array<binary>"}
    def shaped(rows: DataFrame, *has: str) -> DataFrame:
        return rows.select("bucket", *[F.col(n) if n in has else F.lit(None).cast(t).alias(n) for n, t in nothing.items()])

    both = shaped(model.numbers, "block", "pos", "rank", "spelled").unionByName(shaped(model.owners, "word", "counts"))
    for i in model.samples:
        both = both.unionByName(shaped(_of(model.states[i], STATE), "block", "parts"))
    letters, samples = model.spelling, list(model.samples)

    def run(batches):
        table = letters.table()
        for bucket, group in _grouped(batches, "bucket"):
            # Of the words of the bucket; in the first place stands what an unknown one has.
            spelling, counts, places = np.zeros(1), np.zeros(1, np.int64), np.zeros((3 * len(samples), 1), np.int64)
            for row in group:
                if row["word"] is not None:
                    spelling, counts = np.append(0.0, hpy.spelled(row["word"].split(b" "), table)), np.append(0, _got(row["counts"], "<u8"))
            by = {row["block"]: row["parts"][0] for row in group if row["parts"] is not None}
            if by:
                places = np.hstack([places, np.vstack([_got(by[i], "<u8").reshape(3, -1) for i in samples])])
            for row in group:
                if row["pos"] is not None:
                    rank = _got(row["rank"])
                    mine = spelling[rank]
                    mine[rank == 0] = _got(row["spelled"], "<f4")
                    yield _found(row["block"], None, bucket, [row["pos"], row["rank"], _put(mine, "<f4"), _put(np.vstack([counts[rank], places[:, rank]]).ravel(), "<u8")])

    return model.net.dealt(both, "bucket").mapInArrow(run, _FOUND)


def _found_pairs(model: Model) -> DataFrame:
    """Of the pairs of a block in a cell: how often training has them, and their tables in all samples."""
    both, samples = _of(model.cells, PLACES, DISHES), [(i, model.roots[i - 1].weight) for i in model.samples]
    for i, _ in samples:
        both = both.unionByName(_of(model.states[i - 1], SENT))
    net = model.net

    def run(batches):
        for cell, group in _grouped(batches, "cell"):
            # In the first places stand pairs that training does not have, and those that it has once.
            n, tables = np.array([0, 1]), np.array([0, len(samples)])
            for row in group:
                if row["kind"] == DISHES:
                    dishes = Dishes(cell, row["parts"], net)
                    drawn = [dishes.tables([r for r in group if r["kind"] == SENT and r["block"] == i - 1], i, weight) for i, weight in samples]
                    n, tables = np.append(n, dishes.n), np.append(tables, sum(drawn))
            for row in group:
                if row["kind"] == PLACES:
                    at = _got(row["parts"][0])
                    at[at > 1] = np.cumsum(at[at > 1] - 1) + 1
                    yield _found(row["block"], cell, None, [_put(n[at], "<u8"), _put(tables[at], "<u8")])

    return net.dealt(both, "cell").mapInArrow(run, _FOUND)


class Weights:
    """What the words of a block add to the probabilities of pairs, by sample: as the word before and as the word.

    The spelling of an unknown word, log10, is kept apart, as the probability of a long one is below what a double can hold.
    """

    def __init__(self, words: int, roots: list[Root]):
        self.roots, self.count, self.apart = roots, np.zeros(words, np.int64), np.zeros(words)
        self.samples = [(np.empty(words), np.empty(words)) for _ in roots]

    def put(self, at: np.ndarray, places: np.ndarray, spelling: np.ndarray) -> None:
        """Of some words: counts and, by sample, tables of their context restaurants and customers and tables in the root; log10 of their spelling."""
        count, known = places[0], places[0] > 0
        base = np.where(known, 10.0 ** spelling, 1.0)
        self.count[at], self.apart[at] = count, np.where(known, 0.0, spelling)
        for i, (root, (pull, whole)) in enumerate(zip(self.roots, self.samples, strict=True)):
            open_, customers, root_tables = places[1 + 3 * i: 4 + 3 * i]
            pull[at] = (CONTEXT_S + CONTEXT_D * open_) / (CONTEXT_S + count)
            whole[at] = (customers - ROOT_D * root_tables) / (ROOT_S + root.customers) + root.pull() * base

    def chances(self, n: np.ndarray, tables: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of pairs, averaged over samples: how often training has them, their tables in all samples, and which words they are."""
        out = np.empty(len(n))
        for at in range(0, len(n), PAIRS_AT_ONCE):
            part = slice(at, at + PAIRS_AT_ONCE)
            chance = (len(self.samples) * n[part] - CONTEXT_D * tables[part]) / (CONTEXT_S + self.count[before[part]])
            for pull, whole in self.samples:
                chance += pull[before[part]] * whole[word[part]]
            out[part] = np.log10(chance / len(self.samples)) + self.apart[word[part]]
        return out


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held, n_tokens, n_known, base_score, score of the documents of ``hpy.blocks``.

    What buckets and cells know of the words and pairs of a block meets the block's documents in one task.
    """
    total, distinct, net, roots = model.tokens, model.distinct, model.net, [model.roots[i] for i in model.samples]
    answers = _found_words(model).unionByName(_found_pairs(model))
    both = net.dealt(answers.unionByName(_chunks(rows), allowMissingColumns=True), "block")

    def run(batches):
        for _, group in _grouped(batches, "block"):
            chunks, words = [row for row in group if row["docs"] is not None], [row for row in group if row["bucket"] is not None]
            places_of = [_risen(row["parts"][0]) for row in words]
            b = Block([(row["bucket"], pos, _got(row["parts"][1])) for row, pos in zip(words, places_of, strict=True)], net)
            weights = Weights(len(b.number), roots)
            for row, pos in zip(words, places_of, strict=True):
                weights.put(pos, _got(row["parts"][3], "<u8").reshape(1 + 3 * len(roots), -1), _got(row["parts"][2], "<f4"))
            known, chance = {row["cell"]: row["parts"] for row in group if row["cell"] is not None}, np.empty(sum(d["n"] for row in chunks for d in row["docs"]), np.float32)
            for of, found in b.pairs(chunks):
                kinds, place = _distinct(found)
                before, word = b.words_of(kinds)
                n, tables = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
                for cell, at in b.cells(before, word):
                    n[at], tables[at] = (_got(x, "<u8") for x in known[cell])
                chance[of] = weights.chances(n, tables, before, word)[place]
            base, at = np.log10((weights.count + 0.5) / (total + 0.5 * (distinct + 1))), 0
            for row in chunks:
                docs, ids = row["docs"], hpy._unsqueezed(row["data"])
                starts = np.cumsum([0, *[d["n"] for d in docs[:-1]]])
                sums = [np.add.reduceat(x, starts) for x in ((weights.count[ids] > 0).astype(np.int64), base[ids], chance[at: at + len(ids)].astype(np.float64))]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array([d["held"] for d in docs], pa.bool_()), pa.array([d["n"] for d in docs], pa.int64()), *map(pa.array, sums)],
                                                 names=["doc_id", "held", "n_tokens", "n_known", "base_score", "score"])

    return both.mapInArrow(run, "doc_id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, score double")
