import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from conftest_llm import EDGES, FOLDER, frame

from grainwise.llm import bpe
from grainwise.llm.queries import QUERIES, RANKS


def expected(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in texts:
        ids = own.encode_ordinary(t or "")
        yield (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def check(spark, docs, **options):
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, **options).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(texts))


def test_edges_in_small_chunks(llm):
    check(llm, frame(llm, EDGES), chunk=200, overlap=40)


def test_stitching_of_random_texts(llm):
    rng = random.Random(5)
    parts = ["the ", "'re", "'s", "  ", "\n\n ", " ", "x", "9", "!!", "\x1f", "é", "🎉", " ", "we'", "ll ", "word" * 30, " " * 45]
    texts = ["".join(rng.choices(parts, k=rng.randint(50, 400))) for _ in range(60)]
    check(llm, frame(llm, texts + texts[:5]), chunk=100, overlap=30)
    check(llm, frame(llm, texts), chunk=41, overlap=20)


def test_repeated_rows_null_ids_and_empty_tables(llm):
    rows = [(1, "word " * 100), (1, "word " * 100), (1, "other " * 100), (None, "word " * 100), (None, None)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string")
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=100, overlap=30)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(t) for t in expected(rows))
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_decode_gives_the_bytes_back(llm):
    docs = frame(llm, EDGES)
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=200, overlap=40, ids=True)
    raw = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()}
    assert raw == {i: (t or "").encode() for i, t in enumerate(EDGES)}


def test_query(llm):
    docs = llm.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op1_byte_bpe"](llm, FOLDER).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected([(r["doc_id"], r["text"]) for r in docs.collect()]))
