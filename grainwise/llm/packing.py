"""Concatenate and cut: token totals, prefix sums, fixed windows over one global stream of ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainwise.llm.common import ready, stored

WIDTH = 2048
END = 1
KNOWN_WORDS, KNOWN_BYTES = 400_000, 32 << 20
# Code points below this are precomposed letters with simple lower-case forms; signs that may trail a word.
LATIN = 0x250
TRAILING = ".,!*$%&#|?;:"


class Known(dict):
    """Ids, as bytes, of the runs between blanks that this worker has met; emptied at KNOWN_WORDS runs or KNOWN_BYTES.

    A run of Latin letters, with or without trailing punctuation, is one or two pre-tokens, whose merges the model gives
    directly; any other run goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.coder = Tokenizer.from_file(tokenizer_file)
        self.model = self.coder.model
        # The letters that stand for the bytes of a word, as the tokenizer's own byte-level step writes them.
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0x61, LATIN)}
        self.size = 0

    def __missing__(self, run: str) -> bytes:
        if len(self) > KNOWN_WORDS or self.size > KNOWN_BYTES:
            self.clear()
            self.size = 0
        word = run.rstrip(TRAILING)
        low = word.lower()
        if not low.isalpha() or ord(max(low)) >= LATIN:
            found = self._ids(e.ids for e in self.coder.encode_batch_fast([run], add_special_tokens=False))
        elif len(word) < len(run):
            found = self[word] + self[run[len(word):]]
        else:
            found = self._ids([[t.id for t in self.model.tokenize(low.translate(self.signs))]])
        self[run] = found
        self.size += len(run) + len(found)
        return found

    @staticmethod
    def _ids(lists) -> bytes:
        return b"".join(np.array(ids, "<u4").tobytes() for ids in lists)


_KNOWN: dict[str, Known] = {}


def tokens(docs: DataFrame, tokenizer_file: str, end: int = END) -> DataFrame:
    """(task, place, doc_id, n, ids) per row: ids as little-endian 32-bit integers, ``end`` after each document.

    ``place`` is the prefix sum of ids within the task. The tokenizer splits at blanks and works on each run between
    blanks by itself, so each run is encoded once per worker and then looked up.
    """
    ready(docs.sparkSession)

    def run(batches):
        known = _known(tokenizer_file)
        task, place, tail = TaskContext.get().partitionId(), 0, np.array([end], "<u4").tobytes()
        for batch in batches:
            ids, places, counts = [], [], []
            for text in batch.column("text").to_pylist():
                row = b"".join(map(known.__getitem__, (text or "").replace("\n", " ").split(" "))) + tail
                ids.append(row)
                places.append(place)
                counts.append(len(row) // 4)
                place += counts[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(ids), pa.int64()), pa.array(places, pa.int64()), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["task", "place", "doc_id", "n", "ids"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "task bigint, place bigint, doc_id bigint, n bigint, ids binary"))


def _known(tokenizer_file: str) -> Known:
    """One table per worker process, kept from task to task."""
    if tokenizer_file not in _KNOWN:
        _KNOWN[tokenizer_file] = Known(tokenizer_file)
    return _KNOWN[tokenizer_file]


def windows(total: int, width: int = WIDTH) -> tuple[int, list[int]]:
    """Full windows, and the lengths of the last ones: the rest as descending powers of two, which need no padding."""
    rest = total % width
    return total // width, [1 << b for b in reversed(range(width.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_file: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary).

    First pass: documents are encoded once and stored with their place in their task; the totals of the tasks are summed
    up (one row per task). Second pass: place + offset of the task is the place in the stream of all ids, which is cut
    every ``width`` ids; a document that crosses cuts gets one piece, the boundary record, per sequence. All sequences
    are full; the last ids make sequences of descending powers of two.

    A NULL or empty text is the end id alone. Repeated rows are documents of their own. No row is shuffled, apart from
    the totals. The order of documents is the order of the scan.
    """
    coded = stored(tokens(docs, tokenizer_file, end), "tokens")
    totals = coded.groupBy("task").agg(F.sum("n").alias("total"))
    # One row per task of the scan: the only global order in the operator.
    sums = totals.select("task", (F.sum("total").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"), "total")
    offsets = {r["task"]: r["before"] for r in sums.collect()}
    total = totals.agg(F.sum("total")).first()[0] or 0
    full, rest = windows(total, width)
    last = [full * width + x for x in np.cumsum([0, *rest]).tolist()]

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for task, place, doc, n, ids in zip(*(batch.column(k).to_pylist() for k in ("task", "place", "doc_id", "n", "ids")), strict=True):
                begin = offsets[task] + place
                at = begin
                while at < begin + n:
                    if at < full * width:
                        seq, inside, stop = at // width, at % width, (at // width + 1) * width
                    else:
                        k = int(np.searchsorted(last, at, side="right")) - 1
                        seq, inside, stop = full + k, at - last[k], last[k + 1]
                    stop = min(stop, begin + n)
                    piece = ids[4 * (at - begin): 4 * (stop - begin)]
                    for k, v in zip(out, (doc, at - begin, stop - at, zlib.crc32(piece), n, seq, inside, piece), strict=True):
                        out[k].append(v)
                    at = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    return coded.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
