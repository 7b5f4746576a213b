import random
import re

import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import EDGES, FOLDER, frame

from grainwise.llm import caps, minhash
from grainwise.llm.common import components, shingles, word_hashes
from grainwise.llm.queries import QUERIES, SQL


def groups(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(a) for a in range(n)]


def text_sets(texts, n):
    out = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(words[i: i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def similar(x, y):
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("n", [4, 5])
def test_groups_equal_brute_force(llm, n):
    rng = random.Random(n)
    texts = list(EDGES)
    for _ in range(12):  # groups of copies at all distances around the threshold, chains among them
        own = [f"v{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        texts += [" ".join(own), " ".join(own).upper(), *[near(rng, own, e) for e in (1, 1, 2, 3, 4, 6)]]
        last = own
        for _ in range(6):
            last = near(rng, last, 2).split()
            texts.append("\n".join(last))
    sets = text_sets(texts, n)
    got = {r["doc_id"]: r for r in minhash.near_copies(frame(llm, texts), words=n).collect()}
    want = groups(len(texts), lambda a, b: similar(sets[a], sets[b]))
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_links_across_components_of_one_band(llm):
    """A class far from the smallest of its band, but near another one, is still linked."""
    base = [f"a{i}" for i in range(100)]
    texts = []
    for k in range(14):  # each shares about 0.9 with the next, the ends little with each other
        texts.append(" ".join([f"b{j}" for j in range(3 * k)] + base[3 * k:]))
    sets = text_sets(texts, 4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(frame(llm, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == groups(len(texts), lambda a, b: similar(sets[a], sets[b]))


def test_a_group_whose_members_hang_together_by_chains(llm):
    """2,000 chained copies, none of which is near all others, in shuffled order; blocks of 100 classes."""
    rng = random.Random(12)
    own, texts = [f"v{i}" for i in range(120)], []
    for k in range(2_000):
        texts.append(" ".join(own))
        own[(7 * k) % 120] = f"w{k}"
    order = rng.sample(range(2_000), 2_000)
    docs = llm.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    for block in (100, 5_000):
        minhash.BLOCK, before = block, minhash.BLOCK
        try:
            got = minhash.near_copies(docs).select("component_id", "kept").distinct().collect()
        finally:
            minhash.BLOCK = before
        assert {r["component_id"] for r in got} == {0}


def test_recall_at_exactly_the_threshold(llm):
    """400 pairs of sets of 90 shingles that share 80: a similarity of exactly 0.8."""
    texts = []
    for k in range(400):
        own = [f"p{k}w{i}" for i in range(93)]
        texts += [" ".join(own), " ".join([*own[:83], *[f"q{k}w{i}" for i in range(10)]])]
    sets = text_sets(texts, 4)
    assert all(100 * len(sets[i] & sets[i + 1]) == 80 * len(sets[i] | sets[i + 1]) for i in range(0, 800, 2))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(frame(llm, texts)).collect()}
    assert sum(got[i + 1] == i for i in range(0, 800, 2)) == 400


def test_null_ids_repeated_rows_and_empty_tables(llm):
    rows = [(None, "one two three four five"), (5, "one two three four five"), (5, "one two three four five"), (4, "ONE two three  four five"), (7, None), (8, "x"), (8, "y"), (6, "y")]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_copies(docs).collect())
    assert got == sorted([("None", "None", True), ("5", "4", False), ("5", "4", False), ("4", "4", True), ("7", "7", True), ("8", "6", False), ("8", "6", False), ("6", "6", True)])
    assert minhash.near_copies(docs.limit(0)).count() == 0


def merged_sources(llm):
    """Id 1 carries two texts without a common word; 3 is similar to the one, 4 to the other."""
    one, two = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (3, " ".join([*one[:-1], "x"])), (4, " ".join([*two[:-1], "x"])), (5, "none of these"), (5, "but the id"), (5, ""), (5, None), (5, "")]
    return llm.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_every_set_of_a_repeated_id_is_verified(llm):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_copies(merged_sources(llm)).collect()}
    assert got == {(1, 1, True), (3, 1, False), (4, 1, False), (5, 5, True)}


def test_different_texts_of_one_id_survive(llm):
    docs = merged_sources(llm)
    texts = [r["text"] for r in docs.collect()]
    got = sorted((r["doc_id"], str(r["text"])) for r in corpus_pipeline.one_of_each_group(llm, docs, FOLDER).collect())
    assert got == sorted([(1, texts[0]), (1, texts[1]), (5, texts[4]), (5, texts[5]), (5, ""), (5, "None")])
    assert minhash.one_of_each(docs.select("doc_id", "text").union(docs.select("doc_id", "text"))).count() == 6


def test_word_hashes_follow_the_words():
    a, b = word_hashes(b"The  quick\tbrown"), word_hashes(b"the quick\nBROWN \x0b")
    assert (a == b).all() and len(set(a.tolist())) == 3
    assert len(word_hashes(b"")) == len(word_hashes(b" \n ")) == 0
    long = b"ab " * 800_000 + b"z" * 1_500_000 + b" end"
    h = word_hashes(long)
    assert len(h) == 800_002 and len(set(h.tolist())) == 3 and h[-1] == word_hashes(b"end")[0]
    assert len(shingles(h[:3], 4)) == 1 and len(shingles(h[:0], 4)) == 0


def test_sketch_estimates_similarity_and_fills_every_bin():
    rng = np.random.default_rng(1)
    for size in (1, 3, 50, 2000):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        assert (minhash.sketch(x) < np.uint64(2**63)).all()
    both, mine, other = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    share = [(minhash.sketch(np.concatenate([both, mine]) + np.uint64(k), 1000) == minhash.sketch(np.concatenate([both, other]) + np.uint64(k), 1000)).mean() for k in range(5)]
    assert abs(np.mean(share) - 0.8) < 0.03


def test_components_of_a_path_and_a_star(llm):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components(llm.createDataFrame(edges, "a bigint, b bigint"), "test").collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def vectors(llm, values):
    rows = [(i, v, 0, 1) for i, v in enumerate(values)]
    return llm.createDataFrame(rows, "vec_id bigint, embedding array<float>, links int, x string")


def test_vector_links_equal_brute_force(llm):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    values = [c + rng.standard_normal(64) * s for c in centres for s in (0, 0.05, 0.2, 0.3, 0.35)] + [centres[0] * 3, centres[1], centres[1]]
    values = [np.float32(v).tolist() for v in values] + [None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 63 + [None], [1.0, 2.0], [2.0, 4.0], [5.0]]
    for block in (3, 1000):
        got = {r["vec_id"]: r for r in caps.near_copies(vectors(llm, values), block=block).collect()}

        def linked(a, b):
            x, y = values[a], values[b]
            if any(v is None or not v or None in v or not np.isfinite(v).all() or not np.any(v) for v in (x, y)) or len(x) != len(y):
                return False
            return float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))) >= 0.9
        want = groups(len(values), linked)
        assert [got[i]["component_id"] for i in range(len(values))] == want
        assert [got[i]["n_links"] for i in range(len(values))] == [sum(linked(i, j) for j in range(len(values)) if j != i) for i in range(len(values))]


def test_vector_recall_at_the_threshold(llm):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    values = [v.tolist() for v in np.concatenate([x, y])]
    docs = llm.createDataFrame([(i, v) for i, v in enumerate(values)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in caps.near_copies(docs).collect()}
    assert sum(got[i + 400] == i for i in range(400)) >= 396


def test_vectors_without_ids_and_empty_tables(llm):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None)]
    docs = llm.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in caps.near_copies(docs).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("3", 0, "3", True), ("None", 0, "None", True)]
    assert caps.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op7_minhash", "op9_caps"])
def test_query_against_sql(llm, duck, name):
    got = QUERIES[name](llm, FOLDER)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())
