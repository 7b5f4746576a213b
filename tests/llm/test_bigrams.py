import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import EDGES, FOLDER, frame
from pyspark.sql import functions as F
from test_tables import one_by_one

from grainwise.llm import bigrams, hpy
from grainwise.llm.common import remainder


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def scores(llm, texts, held):
    """By text, in their order, with the texts at the places of ``held`` held out."""
    rows = hpy.model_scores(frame(llm, texts), F.col("doc_id").isin(held))[0].collect()
    return [r["score"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_words_that_end_alike_have_contexts_of_their_own(llm):
    texts = [*["the cat purrs", "the bat flies"] * 40, "the cat purrs", "the cat flies", "the bat purrs", "the bat flies"]
    cat_purrs, cat_flies, bat_purrs, bat_flies = scores(llm, texts, [80, 81, 82, 83])[80:]
    assert cat_purrs > cat_flies + 0.5 and bat_flies > bat_purrs + 0.5


def test_held_out_text_is_less_surprising_than_to_classes(llm):
    docs, held = llm.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet"), remainder(F.col("doc_id"), 5) == 1
    of_words, of_classes = ({r["held"]: r["perplexity"] for r in hpy.perplexity(f(docs, held)[0]).collect()} for f in (hpy.model_scores, hpy.class_scores))
    assert of_words[True] < of_classes[True] and of_words[False] < of_classes[False]


def learnt(llm, texts, held):
    docs = frame(llm, texts)
    net = bigrams.Net(16)
    rows = hpy.stored(hpy.blocks(docs, F.col("doc_id").isin(held), net.buckets, classes=False), "blocks")
    return net, rows, bigrams.learn(rows, net)


def seatings(net, model):
    """By sample: tables by pair, and by word tables of its context, and customers and tables in the root."""
    words = {int(r["bucket"]): bytes(r["word"]).split(b" ") for r in model.owners.collect()}
    def name(group, number):
        return words[number % net.per_group * net.side + group][net.ranks(number)]
    cells, places = model.cells.collect(), {r["cell"] for r in model.cells.collect()}
    assert len(places) == net.side ** 2 > 1
    for i in model.samples:
        of_pairs, of_words = {}, {}
        for r in model.states[i].filter(F.col("kind") == bigrams.STATE).collect():
            for w, values in zip(words[r["bucket"]], bigrams._got(bytes(r["parts"][0]), "<u8").reshape(3, -1).T.tolist(), strict=True):
                of_words[w] = values
        sent = [r.asDict() for r in model.states[i - 1].filter(F.col("kind") == bigrams.SENT).collect()]
        for r in cells:
            if r["kind"] == bigrams.DISHES:
                d = bigrams.Dishes(r["cell"], r["parts"], net)
                t = d.tables([x for x in sent if x["cell"] == r["cell"]], i, model.roots[i - 1].weight)
                for c, w, n, many in zip(d.contexts[d.before].tolist(), d.words[d.word].tolist(), d.n.tolist(), t.tolist(), strict=True):
                    pair = tuple(map(name, net.groups(r["cell"]), (c, w)))
                    assert pair not in of_pairs
                    of_pairs[pair] = n, many
        yield model.roots[i], of_pairs, of_words


def test_scores_follow_from_whole_word_contexts(llm, monkeypatch):
    """Plain loops over the pairs of the texts: counts, sums of tables, and every score by the definition. Blocks are small, so pairs meet from many."""
    monkeypatch.setattr(hpy, "BLOCK_TOKENS", 40)
    rng = random.Random(5)
    texts = [*EDGES, *[" ".join(rng.choices(["a", "cat", "hat", "sat", "On", "mat", "x" * 300], [9, 5, 4, 3, 2, 2, 1], k=rng.randint(0, 14))) for _ in range(60)], "unknown Cat zzzz", "cat new cat"]
    held = [3, 20, 33, len(texts) - 2, len(texts) - 1]
    net, rows, model = learnt(llm, texts, held)
    count, follow, of = Counter(), Counter(), {}
    for i, text in enumerate(texts):
        of[i] = list(zip([b"", *tokens(text)[:-1]], tokens(text), strict=True))
        if i not in held:
            count.update(tokens(text))
            follow.update(of[i])
    assert (model.tokens, model.distinct) == (sum(count.values()), len(count))
    table, cd, cs, rd, rs = model.spelling.table(), hpy.CONTEXT_D, hpy.CONTEXT_S, hpy.ROOT_D, hpy.ROOT_S
    samples = list(seatings(net, model))
    assert len(samples) == hpy.SAMPLES
    for root, of_pairs, of_words in samples:
        assert {k: n for k, (n, _) in of_pairs.items()} == {k: n for k, n in follow.items() if n > 1}
        tables = {k: of_pairs[k][1] if n > 1 else 1 for k, n in follow.items()}
        assert all(1 <= t <= follow[k] for k, t in tables.items())
        for w, (mine, arrived, at_root) in of_words.items():
            assert mine == sum(t for (c, _), t in tables.items() if c == w) and arrived == sum(t for (_, x), t in tables.items() if x == w) and 1 <= at_root <= arrived
        assert (root.customers, root.tables) == (sum(tables.values()), sum(t for *_, t in of_words.values()))
    got = {r["doc_id"]: r for r in bigrams.score(rows, model).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, mine in of.items():
        total = 0.0
        for c, w in mine:
            chance, spelt = 0.0, hpy.spelled([w], table)[0]
            for root, of_pairs, of_words in samples:
                n, t = follow[c, w], of_pairs.get((c, w), (1, 1))[1] if follow[c, w] else 0
                arrived, at_root = of_words[w][1:] if count[w] else (0, 0)
                pull = (rs + rd * root.tables) / (rs + root.customers)
                parent = (arrived - rd * at_root) / (rs + root.customers) + pull * (10.0 ** spelt if count[w] else 1.0)
                chance += (n - cd * t + (cs + cd * (of_words[c][0] if count[c] else 0)) * parent) / (cs + count[c]) / len(samples)
            total += math.log10(chance) + (0.0 if count[w] else spelt)
        assert got[i]["score"] == pytest.approx(total, rel=1e-5), texts[i][:40]
        assert (got[i]["held"], got[i]["n_tokens"], got[i]["n_known"]) == (i in held, len(mine), sum(count[w] > 0 for _, w in mine))


def test_probabilities_after_every_word_sum_to_one(llm):
    net, _, model = learnt(llm, ["a cat sat", "a hat sat on a cat", "cat cat a"] * 9, [])
    words = [w for r in model.owners.collect() for w in bytes(r["word"]).split(b" ")]
    left = 1 - sum(10.0 ** hpy.spelled([w], model.spelling.table())[0] for w in words)
    samples = list(seatings(net, model))
    follow, count = Counter(), Counter()
    for text in ["a cat sat", "a hat sat on a cat", "cat cat a"] * 9:
        follow.update(zip([b"", *tokens(text)[:-1]], tokens(text), strict=True))
        count.update(tokens(text))
    at = {w: i for i, w in enumerate([*words, b"new"])}
    places = np.zeros((1 + 3 * len(samples), len(at)), np.int64)
    for w in words:
        places[:, at[w]] = [count[w], *[x for _, _, of_words in samples for x in of_words[w]]]
    spelling = np.array([*hpy.spelled(words, model.spelling.table()), math.log10(left)])
    weights = bigrams.Weights(len(at), [root for root, *_ in samples])
    weights.put(np.arange(len(at)), places, spelling)
    for c in at:
        n = np.array([follow[c, w] for w in at])
        tables = np.array([sum(of_pairs.get((c, w), (1, 1))[1] for _, of_pairs, _ in samples) if follow[c, w] else 0 for w in at])
        log = weights.chances(n, tables, np.full(len(at), at[c]), np.arange(len(at)))
        assert (10.0 ** log).sum() == pytest.approx(1, abs=1e-9), c


def rows_of(batches):
    return list(hpy._rows(batches))


def test_sweeps_agree_with_seating_customers_one_by_one(monkeypatch):
    """The same functions as in the tasks of cells and buckets, without Spark."""
    counts = {(b"a", b"a"): 12, (b"a", b"c"): 1, (b"bb", b"a"): 4, (b"a", b"bb"): 30, (b"bb", b"bb"): 2, (b"bb", b"c"): 8, (b"c", b"a"): 5, (b"c", b"bb"): 1}
    base = {b"a": 0.03, b"bb": 0.004, b"c": 0.0005}
    monkeypatch.setattr(hpy, "spelled", lambda words, table: np.log10([base[w] for w in words]))
    net = bigrams.Net(16)
    by_bucket = {}
    for w in base:
        by_bucket.setdefault(zlib.crc32(w) % net.buckets, []).append(w)
    number = {w: net.number(b, i) for b, words in by_bucket.items() for i, w in enumerate(words)}
    group = {w: b % net.side for b, words in by_bucket.items() for w in words}
    cells = {}
    for (c, w), n in counts.items():
        cells.setdefault(group[c] * net.side + group[w], []).append((number[c], number[w], n))
    met = []
    for cell, dishes in cells.items():
        c, w, n = np.array(sorted(dishes)).T
        contexts, sizes = np.unique(c, return_counts=True)
        words, index = np.unique(w, return_inverse=True)
        met += rows_of(bigrams._met(cell, [{"block": 0, "parts": [bigrams._steps(contexts), bigrams._put(sizes), bigrams._steps(words), bigrams._put(index), bigrams._put(n)]}], net))
    names, seen, roots = {(group[w], n): w for w, n in number.items()}, {k: [] for k in counts}, []
    def state(sweep, rate, sums):
        out = [r for b, words in by_bucket.items() for r in rows_of(bigrams._state(b, [
            {"kind": None, "parts": [b" ".join(words)]}, *[r for r in (*met, *sums) if r["bucket"] == b]], None, sweep, rate))]
        total = sum(bigrams._got(r["parts"][1], "<u8") for r in out if r["kind"] == bigrams.STATE).tolist()
        return out, bigrams.root_of(*total, sweep)
    for seed in range(150):
        monkeypatch.setattr(bigrams, "SEED", 1000 + seed)
        rows, root = state(0, None, [])
        for sweep in range(1, 15):
            sums = []
            for r in met:
                if r["kind"] == bigrams.DISHES:
                    d = bigrams.Dishes(r["cell"], r["parts"], net)
                    t = d.tables([x for x in rows if x["kind"] == bigrams.SENT and x["cell"] == r["cell"]], sweep, root.weight)
                    sums += rows_of(d.sums(t))
                    if sweep > 3:
                        for c, w, x in zip(d.contexts[d.before].tolist(), d.words[d.word].tolist(), t.tolist(), strict=True):
                            seen[tuple(names[k] for k in zip(net.groups(r["cell"]), (c, w), strict=True))].append(x)
            rows, root = state(sweep, root.rate(sweep), sums)
            if sweep > 3:
                roots.append(root.tables)
    wanted, root_tables = one_by_one(counts, base, 6000, random.Random(3))
    for k, n in counts.items():
        assert (np.mean(seen[k]) if n > 1 else 1) == pytest.approx(wanted[k], rel=0.06), k
    assert np.mean(roots) == pytest.approx(root_tables, rel=0.06)


def test_a_common_word_is_dealt_to_many_cells_and_repeats_are_counted(llm):
    texts = [f"the w{i}" for i in range(300)] * 2 + [f"w{i} the" for i in range(300)]
    net, _, model = learnt(llm, texts, [])
    bucket = zlib.crc32(b"the") % net.buckets
    words = next(bytes(r["word"]).split(b" ") for r in model.owners.collect() if r["bucket"] == bucket)
    group, the = bucket % net.side, net.number(bucket, words.index(b"the"))
    dishes = [bigrams.Dishes(r["cell"], r["parts"], net) for r in model.cells.filter(F.col("kind") == bigrams.DISHES).collect()]
    # The start before "the" is one dish with 600 customers; every "the w" has two, as have the ends after these words.
    assert sum(len(d.n) for d in dishes) == 1 + 300 + 300 + 1
    after = sorted(int((d.contexts[d.before] == the).sum()) for d in dishes if net.groups(d.cell)[0] == group)
    assert sum(after) == 300 + 1 and sum(n > 100 for n in after) == net.side == 2
