import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import EDGES, FOLDER, frame
from pyspark.sql import functions as F

from grainwise.llm import hpy
from grainwise.llm.common import remainder
from grainwise.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def check(rows, texts, held):
    train = Counter(t for i, x in texts.items() if not held(i) for t in tokens(x))
    total = sum(train.values())
    for r in rows:
        mine = tokens(texts[r["doc_id"]])
        base = sum(math.log10((train[t] + 0.5) / (total + 0.5 * (len(train) + 1))) for t in mine)
        assert (r["n_tokens"], r["n_known"]) == (len(mine), sum(train[t] > 0 for t in mine))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"])
    return total


def test_base_counts_on_edges_in_small_blocks(llm, monkeypatch):
    docs = frame(llm, [*EDGES, *["the cat sat on the mat"] * 30])
    scored, model = hpy.model_scores(docs, remainder(F.col("doc_id"), 5) == 1)
    rows = scored.collect()
    assert len(rows) == docs.count()
    total = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    assert model.tokens == total


def test_probabilities_sum_to_one(llm):
    """Over all continuations of a text: known words by the model, all other strings by what is left to the spelling."""
    docs = frame(llm, ["a b a c", "b a a", "c c b a"] * 20)
    rows = hpy.stored(hpy.blocks(docs, F.lit(False)), "blocks")
    model = hpy.learn(rows.filter("word IS NOT NULL"))
    words = {bytes(r["word"]): r for r in model.words.collect()}
    table = model.spelling.table()
    left = 1 - sum(10.0 ** hpy.spelled([w], table)[0] for w in words)
    for context in (0, ord("a"), ord("c")):
        mass = 0.0
        for r in words.values():
            types = np.frombuffer(r["contexts"], np.uint8)
            extra = np.frombuffer(r["extra"], np.float64)[types == context].sum()
            mass += (extra + sum(s.pull()[context] * p for s, p in zip(model.samples, r["roots"], strict=True))) / len(model.samples)
        mass += sum(s.pull()[context] * s.root_pull() for s in model.samples) / len(model.samples) * left
        assert mass == pytest.approx(1, abs=1e-6)


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(2)
    for customers, new in ((5, 2.0), (40, 0.3), (3000, 1.5)):
        many = hpy.seated(np.full(3000, customers), np.full(3000, new), 0.5, rng)
        one = []
        for _ in range(300):
            t = 1
            for n in range(1, customers):
                t += rng.random() < new / (new + n - 0.5 * t)
            one.append(t)
        assert abs(many.mean() - np.mean(one)) < 5 * np.std(one) / np.sqrt(300) + 0.05
    assert (hpy.seated(np.array([1, 1]), np.array([9.0, 9.0]), 0.5, rng) == 1).all()
    assert len(hpy.seated(np.zeros(0, int), np.zeros(0), 0.5, rng)) == 0


def test_spelling_sums_to_one_and_prefers_seen_letters(llm):
    table = hpy.spelling(llm.createDataFrame([(w.encode(),) for w in ("the", "then", "there", "über", "")], "word binary")).table()
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-4)
    a, b, c = hpy.spelled([b"the", b"xqz", b""], table)
    assert a > b and c < 0


def test_no_training_and_empty_tables(llm):
    docs = frame(llm, ["a b", None])
    rows = hpy.model_scores(docs, F.lit(True))[0].collect()
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in rows) == [(1, 0, 0.0), (3, 0, 0.0)]
    assert hpy.model_scores(docs.limit(0), F.lit(True))[0].count() == 0


def test_query_beats_the_base_on_held_out_text(llm):
    folder = FOLDER.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_lm_scores"](llm, folder).collect()
    total = check(rows, texts, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    assert len(rows) == len(texts) and all(r["train_tokens"] == total and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
    known = [r for r in rows if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known)
