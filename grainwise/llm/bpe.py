"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where they agree, and encoded piece by piece."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainwise.llm.common import per_text, ready, stored

CHUNK = 16_384
OVERLAP = 512
# The pattern looks at most this many characters ahead of where a match starts before it decides what matches there.
AHEAD = 3
KEY = ["doc_id", "digest", "chars"]


def codec(ranks_file: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder and the bytes of each id."""
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), words


def boundaries(text: str, pattern: regex.Pattern) -> np.ndarray:
    """Where matches end on a non-blank; the pattern covers every character.

    After a blank a text is not cut: how a run of blanks is matched depends on what follows it.
    """
    return np.fromiter((m.end() for m in pattern.finditer(text) if not text[m.end() - 1].isspace()), dtype=np.int64)


def _digests(ids: list[int], words: list[bytes], names: list[str]) -> tuple[str, str]:
    return (hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(),
            hashlib.sha256(b"".join([words[i] for i in ids])).hexdigest())


def encode(docs: DataFrame, ranks_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids (array<int>) of every text.

    A text of one chunk is one piece. Longer texts are cut into overlapping chunks which are spread over the cluster.
    Each chunk is pre-tokenised from its own start; the first boundary that two neighbours share in their overlap is a
    true one if the left neighbour is right there, because the pattern has no look-behind; the text between two such
    points is a piece that encodes on its own. The first chunk is right from its start, and so is every chunk that meets
    a right neighbour. Neighbours without a shared boundary (one run longer than the overlap) stay one piece, and the
    right one counts again from its first blank after a non-blank: no match can span those two.

    A NULL text is empty and has no ids. Repeated rows give repeated results. A NULL doc_id is kept.
    """
    long_text = F.char_length(F.coalesce(F.col("text"), F.lit(""))) > chunk
    short = per_text(docs.filter(~long_text), lambda: _whole(ranks_file, pattern, ids), _schema(ids))
    return short.unionByName(_stitched(docs.filter(long_text), ranks_file, pattern, chunk, overlap, ids))


def _schema(ids: bool) -> str:
    return "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids


def _whole(ranks_file: str, pattern: str, want_ids: bool):
    encoder, words = codec(ranks_file, pattern)
    names = [str(i) for i in range(len(words))]

    def work(text: str) -> tuple:
        found = encoder.encode_ordinary(text)
        return (len(found), *_digests(found, words, names), *([found] if want_ids else []))
    return work


def _stitched(docs: DataFrame, ranks_file: str, pattern: str, chunk: int, overlap: int, want_ids: bool) -> DataFrame:
    ready(docs.sparkSession)
    step = chunk - overlap
    if step <= overlap:
        raise ValueError("a chunk must be more than twice its overlap")
    # The installed regex module counts four control characters as blanks which the encoder's engine does not.
    own = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

    def cut(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                digest = hashlib.sha256(text.encode()).digest()
                last = max(0, -(-(len(text) - chunk) // step))
                for at in range(0, last + 1, 64):
                    some = range(at, min(at + 64, last + 1))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([doc] * len(some), pa.int64()), "digest": [digest] * len(some),
                        "chars": pa.array([len(text)] * len(some), pa.int64()), "seq": pa.array(list(some), pa.int64()),
                        "part": [text[i * step: i * step + chunk] for i in some]})

    # Repeated rows become one set of chunks and a count; the same shuffle spreads the chunks of a long text.
    parts = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
             .mapInArrow(cut, "doc_id bigint, digest binary, chars bigint, seq bigint, part string")
             .groupBy(*KEY, "seq").agg(F.first("part").alias("part"), F.count("*").alias("copies")))

    def mark(batches):
        compiled = regex.compile(own)
        break_at = regex.compile(r"\P{White_Space}\p{White_Space}")
        for batch in batches:
            left, right, sure = [], [], []
            for seq, part in zip(batch.column("seq").to_pylist(), batch.column("part").to_pylist(), strict=True):
                at = boundaries(part, compiled)
                first = break_at.search(part)
                sure.append(None if first is None else first.start() + 1 + seq * step)
                at = at[at <= len(part) - AHEAD]
                left.append(at[at < overlap] + seq * step)
                right.append(at[at >= step] + seq * step)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, kind), pa.array(right, kind), pa.array(sure, pa.int64())],
                                             names=[*batch.schema.names, "left", "right", "sure"])

    marked = stored(parts.mapInArrow(mark, "doc_id bigint, digest binary, chars bigint, seq bigint, part string, copies bigint, `left` array<bigint>, `right` array<bigint>, sure bigint"), "chunks")

    # Marks only, without texts: one small row per chunk, in the order of its document.
    order = Window.partitionBy(*KEY).orderBy("seq")
    meet = F.array_min(F.array_intersect(F.lag("right").over(order), F.col("left")))
    met = (marked.select(*KEY, "seq", "left", "right", "sure").select(*KEY, "seq", meet.alias("meet"), F.lag("sure").over(order).alias("sure"))
           .withColumn("lost", F.sum(((F.col("seq") > 0) & F.col("meet").isNull()).cast("int")).over(order)))
    right_again = F.max(F.col("sure") <= F.col("meet")).over(Window.partitionBy(*KEY, "lost").orderBy("seq"))
    begin = F.when(F.col("seq") == 0, F.lit(0).cast("bigint")).when((F.col("lost") == 0) | right_again, F.col("meet"))
    # Where the piece of a chunk begins and ends: the last cut up to the chunk and the first one after it.
    plan = met.select(*KEY, "seq", begin.alias("begin")).select(
        *[F.col(k).alias(f"{k}1") for k in KEY], F.col("seq").alias("seq1"),
        F.sum(F.col("begin").isNotNull().cast("int")).over(order).alias("piece"), F.max("begin").over(order).alias("first"),
        F.coalesce(F.min("begin").over(order.rowsBetween(1, Window.unboundedFollowing)), F.col("chars")).alias("until"))
    pieces = (marked.select(*KEY, "seq", "part", "copies").join(plan, _same(KEY, "1") & (F.col("seq") == F.col("seq1")))
              .select(*KEY, "seq", "part", "copies", "piece", "first", "until"))

    def encode_piece(rows: pd.DataFrame) -> pd.DataFrame:
        encoder, words = _cached(ranks_file, pattern)
        rows = rows.sort_values("seq")
        first, until = int(rows["first"].iloc[0]), int(rows["until"].iloc[0])
        texts, seqs = rows["part"].tolist(), rows["seq"].tolist()
        text = "".join(t[: step] for t in texts[:-1]) + texts[-1]
        begin = seqs[0] * step
        found = np.array(encoder.encode_ordinary(text[first - begin: until - begin]), dtype=_width(words))
        out = rows[[*KEY, "copies", "piece"]].iloc[:1].copy()
        out["ids"] = [found.tobytes()]
        return out

    encoded = pieces.groupBy(*KEY, "piece").applyInPandas(encode_piece, "doc_id bigint, digest binary, chars bigint, copies bigint, piece bigint, ids binary")

    def join_pieces(rows: pd.DataFrame) -> pd.DataFrame:
        _, words = _cached(ranks_file, pattern)
        found = np.frombuffer(b"".join(rows.sort_values("piece")["ids"]), _width(words)).tolist()
        names = [str(i) for i in range(len(words))] if len(found) > 4 * len(words) else {i: str(i) for i in set(found)}
        coded, decoded = _digests(found, words, names)
        out = {"doc_id": rows["doc_id"].iloc[:1], "n_tokens": len(found), "ids_sha256": coded, "decoded_sha256": decoded, "copies": int(rows["copies"].iloc[0])}
        return pd.DataFrame(out | ({"ids": [found]} if want_ids else {}))

    whole = encoded.groupBy(*KEY).applyInPandas(
        join_pieces, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, copies bigint" + ", ids array<int>" * want_ids)
    return (whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copy", "copies"))


def _width(words: list[bytes]) -> str:
    return "<u2" if len(words) <= 1 << 16 else "<u4"


def _same(keys: list[str], suffix: str):
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}{suffix}"))
    return same


_CODECS: dict = {}


def _cached(ranks_file: str, pattern: str):
    """One codec per worker process; groups are many and small."""
    if (ranks_file, pattern) not in _CODECS:
        _CODECS[ranks_file, pattern] = codec(ranks_file, pattern)
    return _CODECS[ranks_file, pattern]


def decode(rows: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id and bytes of rows (doc_id, ids): the raw bytes of the ids, one after the other; NULL ids give NULL."""
    ready(rows.sparkSession)

    def run(batches):
        _, words = _cached(ranks_file, pattern)
        for batch in batches:
            out = [None if ids is None else b"".join([words[i] for i in ids]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")
