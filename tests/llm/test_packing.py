import zlib

import numpy as np
from conftest_llm import EDGES, FOLDER, frame
from tokenizers import Tokenizer

from grainwise.llm import packing
from grainwise.llm.queries import QUERIES, WORD_BPE


def check(docs, got, width=packing.WIDTH):
    coder = Tokenizer.from_file(WORD_BPE)
    rows, want = docs.select("doc_id", "text").collect(), {}
    for r in rows:
        want.setdefault(r["doc_id"], []).append([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    pieces = sorted((r.asDict() for r in got.collect()), key=lambda r: (r["sequence_id"], r["offset"]))
    stream, ends = [], {}
    at = 0
    while at < len(pieces):  # documents stand in the stream one after the other
        p = pieces[at]
        assert p["start"] == 0
        ids = next(w for w in want[p["doc_id"]] if len(w) == p["doc_tokens"])
        want[p["doc_id"]].remove(ids)
        done = 0
        while done < len(ids):
            p = pieces[at]
            assert p["start"] == done and p["offset"] == ends.get(p["sequence_id"], 0)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[done: done + p["length"]], "<u4").tobytes())
            done += p["length"]
            ends[p["sequence_id"]] = p["offset"] + p["length"]
            at += 1
        stream += ids
    assert not any(want.values())
    sizes = [ends[k] for k in sorted(ends)]
    assert sorted(ends) == list(range(len(ends))) and sum(sizes) == len(stream)
    assert all(s <= width and s & (s - 1) == 0 for s in sizes) and sizes.count(width) == len(stream) // width


def test_edges(llm):
    docs = frame(llm, [*EDGES, "Ümlaut ÀÉ I'll\x0bdon't\x1cx　y " * 50])
    for width in (64, 2048):
        check(docs.repartition(3), packing.pack(docs.repartition(3), WORD_BPE, width=width).drop("ids"), width)
    assert packing.pack(docs.limit(0), WORD_BPE).count() == 0


def test_repeated_rows_are_documents(llm):
    docs = llm.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None)], "doc_id bigint, text string")
    check(docs, packing.pack(docs, WORD_BPE, width=4), 4)


def test_windows():
    assert packing.windows(0) == (0, [])
    assert packing.windows(2048 * 3 + 21) == (3, [16, 4, 1])


def test_query(llm):
    check(llm.read.parquet(f"{FOLDER}/documents.parquet"), QUERIES["op4_packing"](llm, FOLDER))
