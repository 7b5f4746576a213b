"""Near copies of texts: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import components, mixed, per_text, ready, shingles, stored, word_hashes
from grainwise.llm.vectors import runs

# 32 bands of 5 bins: a pair at the similarity of 0.8 shares none with a chance of 3 in a million.
BANDS, ROWS = 32, 5
# One bit of every bin is kept besides. Two sets at similarity s agree in (1 + s) / 2 of them on average; a pair whose
# agreement lies SPREAD standard deviations below that of the wanted similarity is not verified (3 in a million at it).
SIZE, SPREAD = 1024, 4.5
# A bucket with more classes, or more bytes of sets, than this is compared in pairs of its blocks.
BLOCK, BLOCK_BYTES = 1000, 64 << 20
_LOW = np.uint64((1 << 40) - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One value per bin, none empty, for a non-empty set of hashes.

    In each of the first ``size`` rounds every element falls into one bin with a value that is larger than all values of
    earlier rounds; in round size + i all fall into bin i. A bin keeps its smallest value, so later rounds only fill bins
    that are still empty. The share of equal bins estimates the similarity as well as independent minima would.
    """
    bins = np.full(size, np.uint64(2**64 - 1))
    block = max(1, -(-2 * size // len(elements)))
    with np.errstate(over="ignore"):
        for begin in range(0, size, block):
            rounds = np.arange(begin, min(begin + block, size), dtype=np.uint64)[:, None]
            h = mixed(elements[None, :] + (rounds + np.uint64(1)) * _GOLD)
            np.minimum.at(bins, ((h >> np.uint64(40)) % np.uint64(size)).astype(np.int64).ravel(), ((rounds << np.uint64(40)) | (h & _LOW)).ravel())
            empty = np.flatnonzero(bins == np.uint64(2**64 - 1))
            if not len(empty):
                return bins
        for i in empty.tolist():
            last = np.uint64(size + i)
            bins[i] = (last << np.uint64(40)) | (mixed(elements + (last + np.uint64(1)) * _GOLD) & _LOW).min()
    return bins


def bits(values: np.ndarray) -> np.ndarray:
    """One bit per bin, 64 to a number."""
    return np.packbits((mixed(values, 11) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def least_agreement(percent: int, size: int = SIZE, spread: float = SPREAD) -> int:
    p = (1 + percent / 100) / 2
    return int(size * p - spread * (size * p * (1 - p)) ** 0.5)


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash per run of ``rows`` bins; its place in the sketch is part of it."""
    table = values.reshape(-1, rows)
    h = mixed(np.arange(len(table), dtype=np.uint64), 7)
    for i in range(rows):
        h = mixed(h ^ table[:, i], i)
    return h.view(np.int64)


def _signature(words: int):
    def work(text: bytes) -> tuple:
        own = shingles(word_hashes(text), words)
        if not len(own):
            return 0, None, None, None
        bins = sketch(own)
        return len(own), _key(own), bands(bins[: BANDS * ROWS]), bits(bins)
    return work


def _key(own: np.ndarray) -> bytes | None:
    """The same for equal sets; an empty one has none."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _signed(docs: DataFrame, words: int) -> DataFrame:
    ready(docs.sparkSession)
    return stored(per_text(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), lambda: _signature(words), "n_shingles bigint, set_key binary, bands array<bigint>, bits array<bigint>", raw=True), "signed")


def _classes(keyed: DataFrame) -> DataFrame:
    """One row per set, with a number of its own: an id may carry several sets, so that it names none."""
    one = keyed.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"))
    return stored(one.withColumn("cls", F.monotonically_increasing_id()), "classes")


def near_copies(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Two documents are linked if 100 * common >= percent * all of their distinct shingles of ``words`` words, counted on the
    full sets. A document without words is linked with nothing. Rows with equal doc_id count as linked; a NULL doc_id is
    linked with nothing, has no component and is kept.

    Equal sets are one class, kept as its smallest id. Classes that share a band are candidates. In every band each class is
    first compared with one centre, the class that meets the most others in all of its bands; components of those links leave
    only pairs of different components to compare. A bucket that still holds several components is cut into blocks, and every
    pair of its blocks is a cell, so no task holds a group of copies. A cell verifies every pair whose sizes and sketches allow
    the similarity, unless links it has found connect the two already, and gives at most one link per class, so no link
    between components is lost (but for the chances stated above) and no pair becomes a row.
    """
    signed = _signed(docs, words)
    keyed = signed.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = _classes(keyed)
    links = _links(docs, classes, _buckets(classes), words, percent)
    # The sets of one id hang together too.
    mine = keyed.select("doc_id", "set_key").distinct().join(classes.select("set_key", "cls"), "set_key")
    again = mine.groupBy("doc_id").agg(F.min("cls").alias("a"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "a")
    twice = mine.join(again, "doc_id").select("a", F.col("cls").alias("b"))
    named = stored(_named(classes, links.union(twice)).select("set_key", F.col("least.rep").alias("root")), "named")
    return (signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
            .select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("root")), F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, words: int = 4, percent: int = 80, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The ``keep`` columns, doc_id and text among them, of one row per group of similar texts: that of the smallest (doc_id, set).

    Only similar texts make a group here: different texts that share an id stay side by side. Rows without an id stay all; of rows
    without words, those with the same id and text are one.
    """
    classes = _classes(_signed(docs, words).filter("doc_id IS NOT NULL AND set_key IS NOT NULL"))
    named = _named(classes, _links(docs, classes, _buckets(classes), words, percent))
    least = named.select("least.rep", "least.set_key").distinct().withColumn("found", F.lit(True))

    def make():
        return lambda text: (_key(shingles(word_hashes(text), words)),)
    own = per_text(docs.filter("doc_id IS NOT NULL"), make, "own_set binary", keep, raw=True)
    left = own.join(least, (F.col("doc_id") == F.col("rep")) & (F.col("own_set") == F.col("set_key")), "left").filter("found OR own_set IS NULL")
    rest = [k for k in keep if k != "doc_id"]
    one = left.groupBy("doc_id", "own_set", F.when(F.col("own_set").isNull(), F.col("text")).alias("wordless")).agg(F.min(F.struct(*rest)).alias("row"))
    return one.select("doc_id", "row.*").select(*keep).union(docs.filter("doc_id IS NULL").select(*keep))


def _named(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(set_key, least) of every class; ``least`` is the smallest (rep, set_key) of all classes that its links reach."""
    roots = stored(components(links, "roots"), "roots")
    own = F.struct("rep", "set_key")
    linked = classes.select("cls", own.alias("own")).join(roots, F.col("cls") == F.col("id"))
    least = linked.groupBy("root").agg(F.min("own").alias("least"))
    found = roots.join(least, "root").select("id", "least")
    return classes.join(found, classes["cls"] == found["id"], "left").select("set_key", F.coalesce("least", own).alias("least"))


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, cls, n, centre) of the bands that several classes share; ``centre`` is the one that meets the most others in all of its bands."""
    rows = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    full = stored(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "full")
    shared = stored(rows.join(full, "bucket"), "shared")
    met = shared.groupBy("cls").agg(F.sum("size").alias("met"))
    centres = (shared.select("bucket", "cls").join(met, "cls").groupBy("bucket")
               .agg(F.max(F.struct("met", (-F.col("cls")).alias("minus"))).alias("most")).select("bucket", (-F.col("most.minus")).alias("centre")))
    return stored(shared.join(stored(centres, "centres"), "bucket").select("bucket", "cls", "n", "centre"), "buckets")


def _links(docs: DataFrame, classes: DataFrame, shared: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) between the numbers of classes that connect all that is connected."""
    wanted = classes.join(shared.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("rep").alias("doc_id"), "set_key")

    def make():
        def work(text: bytes) -> tuple:
            own = shingles(word_hashes(text), words)
            return _key(own), own.tobytes()
        return work
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    own = per_text(texts, make, "set_key binary, shingles binary", raw=True).groupBy("doc_id", "set_key").agg(F.max("shingles").alias("shingles"))
    sets = stored(own.join(wanted, ["doc_id", "set_key"]).select("cls", "shingles"), "sets")

    star = stored(shared.filter("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct(), "star")
    first = stored(verified(star, sets, percent), "links")
    roots = stored(components(first, "first-roots"), "first-roots")
    placed = stored(shared.join(roots, shared["cls"] == roots["id"], "left").select("bucket", "cls", "n", F.coalesce("root", "cls").alias("root")), "placed")
    # Within a band whose classes fall into several components, all but the largest component are compared with the rest.
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    several = stored(parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("size", "root")).alias("major"),
                                                 F.ceil(F.greatest(F.sum("size") / BLOCK, F.sum("elements") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
                     .filter("parts > 1").select("bucket", "major", "blocks"), "several")
    signs = classes.select(F.col("cls").alias("of"), "bands", "bits")
    opened = placed.join(several, "bucket").join(signs, F.col("cls") == F.col("of"))
    cells = stored(_entered(opened).mapInArrow(_met(percent, verify=False), f"{CELL}, open int").filter("open = 1").drop("open"), "cells")
    rest = cells.join(sets.select(F.col("cls").alias("of"), "shingles"), F.col("cls") == F.col("of")).drop("of")
    cross = _sorted(rest).mapInArrow(_met(percent, verify=True), "a bigint, b bigint")
    return first.union(stored(cross, "cross"))


CELL = "bucket bigint, i int, j int, own int, cls bigint, n bigint, root bigint, major bigint, bands array<bigint>, bits array<bigint>"


def _sorted(cells: DataFrame) -> DataFrame:
    return cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cls")


def _entered(opened: DataFrame) -> DataFrame:
    """The classes of a bucket in all pairs of its blocks that hold them."""
    names = [c.split()[0] for c in CELL.split(", ")]
    return _sorted(opened.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
                   .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                   .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*names))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))


def _met(percent: int, verify: bool):
    """Per cell: its classes that have candidates, or the links between components that its full sets confirm."""
    least = least_agreement(percent)

    def run(batches):
        for cell in runs(batches, ["bucket", "i", "j"]):
            bucket, i, j = (cell.column(k)[0].as_py() for k in ("bucket", "i", "j"))
            cls, n, root, major, own = (cell.column(k).to_numpy() for k in ("cls", "n", "root", "major", "own"))
            band = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
            bit = cell.column("bits").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
            sets = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()] if verify else []
            small, label, met, found = root != major, root.copy(), np.zeros(len(cls), bool), []
            earlier = band < bucket
            for a in np.flatnonzero(small).tolist():
                # Of two classes outside the largest component the earlier one meets the later one.
                other = (root != root[a]) & (~small | (np.arange(len(cls)) > a)) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
                if i != j:
                    other &= own != own[a]
                at = np.flatnonzero(other)
                at = at[SIZE - np.bitwise_count(bit[at] ^ bit[a]).sum(axis=1, dtype=np.int64) >= least]
                # A pair is met in the first band that both have.
                at = at[~((band[at] == band[a]) & earlier[at]).any(axis=1)]
                if not verify:
                    met[a] |= len(at) > 0
                    met[at] = True
                    continue
                for b in at.tolist():
                    if label[a] != label[b]:
                        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                            found.append((cls[a], cls[b]))
                            label[label == label[a]] = label[b]
            if verify:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            else:
                yield from pa.table([*cell.columns, pa.array(met.astype(np.int32))], names=[*cell.column_names, "open"]).combine_chunks().to_batches()
    return run
