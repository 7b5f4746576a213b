"""A hierarchical Pitman-Yor language model: seating sampled by Gibbs sweeps, predictive probabilities averaged.

Two levels of restaurants over words. All context restaurants share one parent, the root restaurant, whose base is a spelling model
over bytes, so that every string has a probability. The contexts of ``model_scores`` are whole words, the one before each word
(``bigrams``). Here are what it takes from documents, the spelling model, the seating of the first state, and a smaller model that
it is held against (``class_scores``), where a context restaurant belongs to the class of the word before, which is its last
byte (0 at the start of a text), so that there are 256 of them at most. What the latter gathers is one entry per distinct word, with
its counts by class; it grows with the corpus and is never collected. Only totals per class and the byte bigrams of the
spelling model, which are bounded by their alphabet, reach the driver.

Words are dealt by hash into buckets; a row holds the words of one bucket, packed one after the other. How many buckets
there are follows the partitions of the input, so a bucket stays as large as it is when the corpus grows. No seating is
stored: that of a bucket after any sweep follows from its counts, the seed, and the totals after the sweeps before.

A sweep draws the tables of every dish from their exact conditional distribution, who sits where being integrated out. What ties
dishes together is drawn as well: the rate at which a restaurant opens tables, of a gamma law that its tables fix, and the weight of
every word in the root restaurant. Given these, all dishes of all contexts are independent, whatever bucket they are in. Rates and
the weight of the whole root follow from the totals of the state before, which is what the sweep takes from other buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tables as seats_of
from grainwise.llm.common import ready, stored

if TYPE_CHECKING:
    from grainwise.llm import bigrams

# Discounts and strengths of the context restaurants and of the root.
CONTEXT_D, CONTEXT_S = 0.7, 20.0
ROOT_D, ROOT_S = 0.6, 50.0
BURN_IN, SAMPLES = 2, 3
# Tokens of a block, the unit in which documents are counted and later scored, and of a chunk of documents in it.
BLOCK_TOKENS = 3_000_000
CHUNK_TOKENS = 100_000
# Buckets of words per partition of the input, and the fewest there are.
BUCKETS_PER_PART, LEAST_BUCKETS = 4, 64
# A row is a bucket or a chunk, so few of them make an Arrow batch.
PACKED_ROWS = 32
# In the state that the sweeps start from: up to this many customers of a dish are seated one by one, then in runs of 1/RUN of those that sit.
ONE_BY_ONE, RUN = 64, 32
SEED = 33


@dataclass(frozen=True)
class Totals:
    """Of one state: customers and tables by context, and of the root, with the weight of the whole root."""
    customers: np.ndarray
    tables: np.ndarray
    root_customers: int
    root_tables: int
    root_weight: float = 1.0

    def rates(self, sweep: int) -> tuple[np.ndarray, float]:
        """Rates at which the contexts and the root open tables in the sweep that follows this state; the same in every task."""
        rng = np.random.default_rng([SEED, sweep, 1 << 40])
        return rng.standard_gamma(CONTEXT_S / CONTEXT_D + self.tables), float(rng.standard_gamma(ROOT_S / ROOT_D + self.root_tables))

    def pull(self) -> np.ndarray:
        """The weight of the parent's probability in every context."""
        return (CONTEXT_S + CONTEXT_D * self.tables) / (CONTEXT_S + self.customers)

    def root_pull(self) -> float:
        return (ROOT_S + ROOT_D * self.root_tables) / (ROOT_S + self.root_customers)


def bucket_count(docs: DataFrame) -> int:
    """Buckets of words for these documents."""
    return max(LEAST_BUCKETS, BUCKETS_PER_PART * docs.rdd.getNumPartitions())


def blocks(docs: DataFrame, held_out: Column, buckets: int | None = None, classes: bool = True) -> DataFrame:
    """Rows of two kinds per block of documents: words of a bucket with their training counts, and chunks of documents.

    word rows: block, bucket, word (the words, blank-separated), pos (their numbers in the block), sizes, contexts and counts
    (types of each word, by context, and how often documents that are not held out have them). Other rows: block, docs (doc_id, held, tokens)
    and data (compressed word numbers, an end token last in every document). The end token is the empty word, number 0.
    Without ``classes``, every word has one type, of context 0, with all its counts.
    """
    ready(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PACKED_ROWS))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    n_buckets = buckets or bucket_count(source)

    def run(batches):
        task, number = TaskContext.get().partitionId() << 32, 0
        table: dict[bytes, int] = {b"": 0}
        rows, tokens = [], 0
        for batch in batches:
            for doc, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").lower().split()
                rows.append((doc, held, np.array([*[table.setdefault(w, len(table)) for w in words], 0], np.uint32)))
                tokens += len(words) + 1
                if tokens >= BLOCK_TOKENS:
                    yield from _block(task + number, rows, table, n_buckets, classes)
                    number, table, rows, tokens = number + 1, {b"": 0}, [], 0
        if rows:
            yield from _block(task + number, rows, table, n_buckets, classes)

    return source.mapInArrow(run, _BLOCK_SCHEMA)


_BLOCK_SCHEMA = ("block bigint, bucket int, word binary, pos binary, sizes binary, contexts binary, counts binary, "
                 "docs array<struct<doc_id: bigint, held: boolean, n: bigint>>, data binary")
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("held", pa.bool_()), ("n", pa.int64())]))
_BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in ("word", "pos", "sizes", "contexts", "counts")], ("docs", _DOCS), ("data", pa.binary())])


def _bytes(numbers: np.ndarray, kind: str) -> bytes:
    return numbers.astype(kind).tobytes()


def _squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte, so that the high bytes, mostly zero, stand together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unsqueezed(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _last_bytes(words) -> np.ndarray:
    return np.array([w[-1] if w else 0 for w in words], np.int64)


def _contexts(ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The class of every token: the last byte of the word before it, 0 after an end token and at the start."""
    return np.concatenate([[0], last[ids[:-1]]])


def _block(block: int, rows: list, table: dict[bytes, int], n_buckets: int, classes: bool) -> Iterator[pa.RecordBatch]:
    words = list(table)
    ids = np.concatenate([r[2] for r in rows]).astype(np.int64)
    held = np.repeat([r[1] for r in rows], [len(r[2]) for r in rows])
    if classes:
        kinds, counts = np.unique((ids << 9) | (_contexts(ids, _last_bytes(words)) << 1) | held, return_counts=True)
        first = np.flatnonzero(np.diff(kinds >> 1, prepend=-1))
        types, counts = kinds[first] >> 1, np.add.reduceat(np.where(kinds & 1, 0, counts), first)
    else:
        types, counts = np.arange(len(words)) << 8, np.bincount(ids[~held], minlength=len(words))
    bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
    sizes = np.bincount(types >> 8, minlength=len(words))
    order, by = np.argsort(bucket, kind="stable"), np.argsort(bucket[types >> 8], kind="stable")
    contexts, counts, sizes = (types & 255)[by], counts[by], sizes[order]
    some = np.unique(bucket)
    edges = np.append(np.searchsorted(bucket[order], some), len(words))
    cuts = np.concatenate([[0], np.cumsum(sizes)])[edges]
    for i, b in enumerate(some.tolist()):
        at, cut = slice(edges[i], edges[i + 1]), slice(cuts[i], cuts[i + 1])
        yield _row(block=block, bucket=b, word=b" ".join([words[j] for j in order[at].tolist()]), pos=_bytes(order[at], "<u4"),
                   sizes=_bytes(sizes[at], "<u2"), contexts=_bytes(contexts[cut], "u1"), counts=_bytes(counts[cut], "<u4"))
    chunk, tokens = [], 0
    for row in rows:
        chunk.append(row)
        tokens += len(row[2])
        if tokens >= CHUNK_TOKENS:
            yield _chunk(block, chunk)
            chunk, tokens = [], 0
    if chunk:
        yield _chunk(block, chunk)


def _chunk(block: int, rows: list) -> pa.RecordBatch:
    return _row(block=block, docs=[{"doc_id": doc, "held": held, "n": len(ids)} for doc, held, ids in rows], data=_squeezed(np.concatenate([r[2] for r in rows])))


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in _BLOCK], schema=_BLOCK)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def vocabulary(words: DataFrame) -> DataFrame:
    """bucket, word, sizes, contexts, counts (64-bit) of the training words: one row per bucket, counts of all blocks summed up.

    A word has one entry per block, so a hot word is no hot key. Rows arrive sorted; one bucket is held at a time.
    """
    rows = words.select("bucket", "word", "sizes", "contexts", "counts").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        bucket, table, types, counts = None, {}, [], []
        for row in _rows(batches):
            if row["bucket"] != bucket:
                if types:
                    yield from _summed(bucket, table, types, counts)
                bucket, table, types, counts = row["bucket"], {}, [], []
            sizes = np.frombuffer(row["sizes"], "<u2").astype(np.int64)
            count = np.frombuffer(row["counts"], "<u4")
            seen, owner = count > 0, np.repeat(np.arange(len(sizes)), sizes)
            trained = np.bincount(owner[seen], minlength=len(sizes)) > 0
            mine = [table.setdefault(w, len(table)) if t else -1 for w, t in zip(row["word"].split(b" "), trained.tolist(), strict=True)]
            types.append((np.array(mine, np.int64)[owner[seen]] << 8) | np.frombuffer(row["contexts"], np.uint8)[seen])
            counts.append(count[seen])
        if types:
            yield from _summed(bucket, table, types, counts)

    return rows.mapInArrow(run, "bucket int, word binary, sizes binary, contexts binary, counts binary")


def _summed(bucket: int, table: dict[bytes, int], types: list, counts: list) -> Iterator[pa.RecordBatch]:
    if table:
        kinds, place = np.unique(np.concatenate(types), return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, place, np.concatenate(counts).astype(np.int64))
        values = (b" ".join(table), _bytes(np.bincount(kinds >> 8, minlength=len(table)), "<u2"), _bytes(kinds & 255, "u1"), _bytes(total, "<u8"))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=["bucket", "word", "sizes", "contexts", "counts"])


# Spelling ----------------------------------------------------------------------------------------------------------

# Contexts of the spelling model: the byte before (256 at the start), and five bits of the one before that, which tell
# apart the letters of the Latin alphabet.
FINER = 32
CELLS = 257 * FINER
BACKOFF = 5.0


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with an end (256) each, their contexts, and where the words end."""
    x = np.frombuffer(b"".join([w + b"\0" for w in words]), np.uint8).astype(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    x[ends] = 256
    one = np.concatenate([[256], x[:-1]])
    two = np.where(one == 256, 256, np.concatenate([[256, 256], x[:-2]])[: len(x)])
    return x, one * FINER + (two & (FINER - 1)), ends


@dataclass(frozen=True)
class Spelling:
    """Counts of the letters that were seen, by cell (context * 257 + letter): CELLS * 257 at most, in practice few."""
    cells: np.ndarray
    counts: np.ndarray

    def table(self) -> np.ndarray:
        """log10 probabilities of a byte or the end after a context; the finer contexts fall back on the byte before alone."""
        seen = np.zeros(CELLS * 257, np.float32)
        seen[self.cells] = self.counts
        seen = seen.reshape(CELLS, 257)
        coarse = seen.reshape(257, FINER, 257).sum(axis=1) + np.float32(0.01)
        coarse = np.repeat(coarse / coarse.sum(axis=1, keepdims=True), FINER, axis=0)
        return np.log10((seen + np.float32(BACKOFF) * coarse) / (seen.sum(axis=1, keepdims=True) + np.float32(BACKOFF)))


def spelling(words: DataFrame) -> Spelling:
    """The spelling model of the distinct words; a row may hold several, blank-separated."""
    def run(batches):
        seen = np.zeros(CELLS * 257, np.int32)
        for batch in batches:
            for packed in batch.column("word").to_pylist():
                x, context, _ = _letters(packed.split(b" "))
                np.add.at(seen, context * 257 + x, 1)
        some = np.flatnonzero(seen)
        for at in range(0, len(some), 50_000):
            part = some[at: at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part].astype(np.int64))], names=["cell", "n"])

    rows = words.select("word").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    return Spelling(np.array([r["cell"] for r in rows], np.int32), np.array([r["n"] for r in rows], np.float32))


def spelled(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """log10 of the spelling model's probability of each word, its end included."""
    x, context, ends = _letters(words)
    sums = np.concatenate([[0.0], np.cumsum(table[context, x], dtype=np.float64)])
    return sums[ends + 1] - np.concatenate([[0.0], sums[ends[:-1] + 1]])


# Seating -----------------------------------------------------------------------------------------------------------

def seated(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sat down one after the other: where the sweeps start from.

    ``new`` is the weight of a new table, (strength + discount * tables of others) * parent's probability; a customer
    joins one of n seated ones at t tables with the weight n - discount * t. The first always opens a table.
    """
    tables = np.ones(len(customers), np.int64)
    n = 1
    active = np.flatnonzero(customers > 1)
    while len(active):
        step = 1 if n < ONE_BY_ONE else n // RUN
        run = np.minimum(step, customers[active] - n)
        weight = new[active]
        chance = weight / (weight + n - discount * tables[active])
        tables[active] += rng.binomial(run, np.clip(chance, 0.0, 1.0)) if step > 1 else rng.random(len(active)) < chance
        n += step
        active = active[customers[active] > n]
    return tables


@dataclass
class Seats:
    """One bucket: its words and types, and what the samples so far add up to."""
    words: list[bytes]
    sizes: np.ndarray
    contexts: np.ndarray
    counts: np.ndarray
    tables: np.ndarray
    root_tables: np.ndarray
    weight: float
    roots: np.ndarray
    extra: np.ndarray


def _seats(row: dict, table: np.ndarray, totals: list[Totals], burn_in: int, sweeps: int) -> Seats:
    """A bucket after ``sweeps`` Gibbs sweeps; ``totals`` are those of the states before, and of this one if known.

    State 0 has one table per type, and its root seats them one by one. In every sweep the tables of all types are drawn
    anew, given the weights of the words in the root, then those of the words in the root, and their weights: of the tables they
    have there and of what may come. The samples are the states after the burn-in whose totals are known.
    """
    words = row["word"].split(b" ")
    sizes = np.frombuffer(row["sizes"], "<u2").astype(np.int64)
    contexts, counts = np.frombuffer(row["contexts"], np.uint8), np.frombuffer(row["counts"], "<u8").astype(np.int64)
    owner, log_base = np.repeat(np.arange(len(words)), sizes), np.log(10.0) * spelled(words, table)
    base = np.exp(log_base)
    roots, extra = [], np.zeros(len(counts))
    tables, coming = np.ones(len(counts), np.int64), np.zeros(len(words))
    for sweep in range(sweeps + 1):
        rng = np.random.default_rng([SEED, sweep, row["bucket"]])
        if sweep:
            rates, root_rate = totals[sweep - 1].rates(sweep)
            weights = np.log(np.maximum(sat + coming, 1e-300)) - np.log(totals[sweep - 1].root_weight)
            tables = seats_of.drawn(counts, np.log(rates)[contexts] + weights[owner], CONTEXT_D, rng)
        arrived = np.bincount(owner, weights=tables, minlength=len(words)).astype(np.int64)
        if sweep:
            root_tables = seats_of.drawn(arrived, np.log(root_rate) + log_base, ROOT_D, rng)
            coming = seats_of.rest(root_rate * base, ROOT_D, rng)
        else:
            root_tables = seated(arrived, ROOT_S * base, ROOT_D, rng)
        sat = rng.standard_gamma(arrived - ROOT_D * root_tables)
        if sweep > burn_in and sweep < len(totals):
            now = totals[sweep]
            roots.append((arrived - ROOT_D * root_tables + (ROOT_S + ROOT_D * now.root_tables) * base) / (ROOT_S + now.root_customers))
            extra += (counts - CONTEXT_D * tables) / (CONTEXT_S + now.customers[contexts])
    return Seats(words, sizes, contexts, counts, tables, root_tables, float(sat.sum()), np.array(roots).reshape(len(roots), len(words)).T, extra)


# Weights of the root are added up as whole multiples of 1 / UNIT, so that their sum does not depend on the order.
UNIT = 1 << 20


def _sums(s: Seats) -> np.ndarray:
    """Customers and tables by context; in the last row those of the root, and the weight of its tables."""
    sums = np.zeros((257, 3), np.int64)
    np.add.at(sums[:, 0], s.contexts, s.counts)
    np.add.at(sums[:, 1], s.contexts, s.tables)
    sums[256] = int(s.tables.sum()), int(s.root_tables.sum()), round(s.weight * UNIT)
    return sums


def _state(sums: np.ndarray, sweep: int) -> Totals:
    """Totals of a state; the root's weight is that of its tables and of all that it has not seated."""
    root_customers, root_tables, weight = (int(x) for x in sums[256])
    unseated = np.random.default_rng([SEED, sweep, 1 << 41]).standard_gamma(ROOT_S + ROOT_D * root_tables)
    return Totals(sums[:256, 0], sums[:256, 1], root_customers, root_tables, weight / UNIT + float(unseated))


def _totals(plain: DataFrame, letters: Spelling, totals: list[Totals], burn_in: int) -> Totals:
    """Totals of the state that follows those of ``totals``."""
    def run(batches):
        table, sums = letters.table(), np.zeros((257, 3), np.int64)
        for row in _rows(batches):
            sums += _sums(_seats(row, table, totals, burn_in, len(totals)))
        yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int64()), *[pa.array(sums[:, i]) for i in range(3)]], names=["c", "customers", "tables", "weight"])

    sums = np.zeros((257, 3), np.int64)
    names = ("customers", "tables", "weight")
    for r in plain.mapInArrow(run, "c bigint, customers bigint, tables bigint, weight bigint").groupBy("c").agg(*[F.sum(n).alias(n) for n in names]).collect():
        sums[r["c"]] = [r[n] for n in names]
    return _state(sums, len(totals))


@dataclass(frozen=True)
class Model:
    """vocabulary: the training words by bucket; totals: of all states, in order, the last ``samples`` of which count."""
    vocabulary: DataFrame
    spelling: Spelling
    totals: tuple[Totals, ...]
    burn_in: int
    distinct: int

    @property
    def tokens(self) -> int:
        return int(self.totals[-1].customers.sum())

    @property
    def samples(self) -> tuple[Totals, ...]:
        return self.totals[self.burn_in + 1:]

    @property
    def packed(self) -> DataFrame:
        """bucket, word, sizes, contexts, n (64-bit), extra and roots (32-bit): the sampled model, by bucket.

        ``extra`` is the sum over samples of what a context adds to its share of the root's probability; ``roots`` are the
        root probabilities by word and sample.
        """
        letters, totals, burn_in = self.spelling, list(self.totals), self.burn_in

        def run(batches):
            table = letters.table()
            for row in _rows(batches):
                s = _seats(row, table, totals, burn_in, len(totals) - 1)
                n = np.bincount(np.repeat(np.arange(len(s.words)), s.sizes), weights=s.counts, minlength=len(s.words))
                values = (row["word"], row["sizes"], row["contexts"], _bytes(n, "<u8"), _bytes(s.extra, "<f4"), _bytes(s.roots, "<f4"))
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), *[pa.array([v], pa.binary()) for v in values]],
                                                 names=["bucket", "word", "sizes", "contexts", "n", "extra", "roots"])
        return self.vocabulary.mapInArrow(run, "bucket int, word binary, sizes binary, contexts binary, n binary, extra binary, roots binary")

    @property
    def words(self) -> DataFrame:
        """One row per training word: word, n, contexts, extra (64-bit), roots."""
        def run(batches):
            for row in _rows(batches):
                words, sizes = row["word"].split(b" "), np.frombuffer(row["sizes"], "<u2").astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                extra, roots = np.frombuffer(row["extra"], "<f4").astype(np.float64), np.frombuffer(row["roots"], "<f4").reshape(len(words), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()), pa.array(np.frombuffer(row["n"], "<i8")), pa.array([row["contexts"][a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                     pa.array([extra[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.array(roots.astype(np.float64).tolist(), pa.list_(pa.float64()))],
                    names=["word", "n", "contexts", "extra", "roots"])
        return self.packed.mapInArrow(run, "word binary, n bigint, contexts binary, extra binary, roots array<double>")


def learn(words: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Gibbs sweeps over the vocabulary: every sweep draws all tables anew, given the totals after the one before.

    A pass over the stored vocabulary gives the totals of one more state; it seats the earlier ones again on its way, which
    costs less than writing them. After the burn-in every state is a sample.
    """
    plain = stored(vocabulary(words), "vocabulary")
    letters = spelling(plain)
    totals: list[Totals] = []
    for _ in range(burn_in + samples + 1):
        totals.append(_totals(plain, letters, totals, burn_in))
    distinct = plain.agg(F.sum(F.length("sizes") / 2)).first()[0]
    return Model(plain, letters, tuple(totals), burn_in, int(distinct or 0))


# Scores ------------------------------------------------------------------------------------------------------------

def _found(rows: DataFrame, model: Model) -> DataFrame:
    """block, n, data: of the words of a block in one bucket, their counts and the probability of each of their types, compressed.

    The rows of a bucket arrive behind the model's; only the latter is held. Probabilities are logarithms: that of a long word
    that the model does not have is below what a double can hold.
    """
    names = ("n", "extra", "roots")
    asked = rows.filter("word IS NOT NULL").select("bucket", "block", "word", "pos", "sizes", "contexts", *[F.lit(None).cast("binary").alias(k) for k in names])
    known = model.packed.select("bucket", F.lit(None).cast("bigint").alias("block"), "word", F.lit(None).cast("binary").alias("pos"), "sizes", "contexts", *names)
    both = known.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    letters, root_pulls, pulls = model.spelling, np.array([s.root_pull() for s in model.samples]), np.stack([s.pull() for s in model.samples]).T

    def run(batches):
        table, bucket = letters.table(), None
        for row in _rows(batches):
            if row["bucket"] != bucket:
                # Of the model: words, their counts and roots, types and what these add; at the end of each stands what an unknown one has.
                bucket, at = row["bucket"], {}
                n, roots, types, extra = np.zeros(1, np.int64), root_pulls[None, :], np.zeros(0, np.int64), np.zeros(1)
            words, sizes, contexts = row["word"].split(b" "), np.frombuffer(row["sizes"], "<u2").astype(np.int64), np.frombuffer(row["contexts"], np.uint8)
            owner = np.repeat(np.arange(len(words)), sizes)
            if row["block"] is None:
                at = {w: i for i, w in enumerate(words)}
                n, types = np.append(np.frombuffer(row["n"], "<i8"), 0), (owner << 8) | contexts
                roots, extra = np.vstack([np.frombuffer(row["roots"], "<f4").reshape(len(words), -1), root_pulls]), np.append(np.frombuffer(row["extra"], "<f4"), 0.0)
                continue
            place = np.array([at.get(w, len(at)) for w in words], np.int64)
            new, spelling = np.flatnonzero(place == len(at)).tolist(), np.zeros(len(words))
            spelling[new] = spelled([words[i] for i in new], table) if new else 0.0
            key = (place[owner] << 8) | contexts
            found = np.searchsorted(types, key)
            found[np.append(types, -1)[found] != key] = len(types)
            chance = (extra[found] + (pulls[contexts] * roots[place[owner]]).sum(axis=1)) / len(root_pulls)
            parts = (row["pos"], _bytes(_last_bytes(words), "u1"), _bytes(n[place], "<u8"), row["sizes"], row["contexts"], _bytes(np.log10(chance) + spelling[owner], "<f4"))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([len(words)], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(parts))], pa.binary())],
                                             names=["block", "n", "data"])

    return both.mapInArrow(run, "block bigint, n int, data binary")


def _lookup(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of a block, from the answers of its buckets: last byte and count by word number; sorted types and their probabilities."""
    total = sum(n for n, _ in parts)
    last, count, types, chances = np.zeros(total, np.int64), np.zeros(total, np.int64), [], []
    for n, data in parts:
        raw, at, took = zstandard.ZstdDecompressor().decompress(data), 0, []
        for kind in ("<u4", "u1", "<u8", "<u2"):
            took.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
        pos, size = took[0], took[3]
        last[pos], count[pos], m = took[1], took[2], int(size.sum())
        types.append((np.repeat(pos, size) << 8) | np.frombuffer(raw, "u1", m, at))
        chances.append(np.frombuffer(raw, "<f4", m, at + m))
    types = np.concatenate(types)
    order = np.argsort(types)
    return last, count, types[order], np.concatenate(chances)[order].astype(np.float64)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held, n_tokens, n_known, base_score, score of the documents of ``blocks``.

    The words of every block are looked up in the model's buckets; answers and documents of a block then meet in one task. So
    a word is moved once per block and not once per place.
    """
    total, distinct = model.tokens, model.distinct
    answers = _found(rows, model).select("block", "n", "data", F.lit(None).cast(rows.schema["docs"].dataType).alias("docs"))
    chunks = rows.filter("word IS NULL").select("block", F.lit(None).cast("int").alias("n"), "data", "docs")
    both = answers.unionByName(chunks).repartition("block").sortWithinPartitions("block", F.col("n").asc_nulls_last())

    def run(batches):
        block, parts, found, base = None, [], None, None
        for row in _rows(batches):
            if row["block"] != block:
                block, parts, found = row["block"], [], None
            if row["docs"] is None:
                parts.append((row["n"], row["data"]))
                continue
            if found is None:
                found, parts = _lookup(parts), []
                base = np.log10((found[1] + 0.5) / (total + 0.5 * (distinct + 1)))
            last, count, types, chances = found
            ids = _unsqueezed(row["data"])
            chance = chances[np.searchsorted(types, (ids << 8) | _contexts(ids, last))]
            starts = np.cumsum([0, *[d["n"] for d in row["docs"][:-1]]])
            sums = [np.add.reduceat(x, starts) for x in ((count[ids] > 0).astype(np.int64), base[ids], chance)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), pa.array([d["held"] for d in row["docs"]], pa.bool_()), pa.array([d["n"] for d in row["docs"]], pa.int64()), *map(pa.array, sums)],
                names=["doc_id", "held", "n_tokens", "n_known", "base_score", "score"])

    return both.mapInArrow(run, "doc_id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """held and perplexity per token by the averaged predictive probabilities."""
    return scored.groupBy("held").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.sum("n_tokens").alias("n_tokens"))


def class_scores(docs: DataFrame, held_out: Column) -> tuple[DataFrame, Model]:
    """Scores by the model whose contexts are the last bytes of words: what the words before add is held against it."""
    rows = stored(blocks(docs, held_out), "blocks")
    model = learn(rows.filter("word IS NOT NULL"))
    return score(rows, model), model


def model_scores(docs: DataFrame, held_out: Column) -> tuple[DataFrame, bigrams.Model]:
    """Scores of all documents by a model of those that are not held out, whose contexts are whole words; a NULL text has the end token alone."""
    from grainwise.llm import bigrams

    net = bigrams.Net(bucket_count(docs))
    rows = stored(blocks(docs, held_out, net.buckets, classes=False), "blocks")
    model = bigrams.learn(rows, net)
    return bigrams.score(rows, model), model
