import math
import random
import zlib

import pytest
from conftest_llm import EDGES, frame
from pyspark.sql import functions as F

from grainwise.llm import quality, toxicity
from grainwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "least"), [("op8_toxicity", "toxic", 0.9), ("op10_quality", "quality", 0.9)])
def test_held_out_accuracy(llm, name, label, least):
    got = QUERIES[name](llm, SF).toPandas()
    truth = llm.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    held = truth[truth["held_out"]]
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (held[label] == held["predicted"]).mean() >= least


def test_disguised_words_count_and_exceptions_do_not(llm):
    table = toxicity.folding()
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " lowei": 4.0, " trash ": 3.0}, ("trash can",), (-3.0, 1.5, 0.5))
    own = lexicon.automaton()
    count = lambda t: len(toxicity.hits(toxicity.fold(t, table), own))
    assert [count(t) for t in ("you 1d10t!", "an іdiоt", "ＩＤＩＯＴ", "loweichen", "a trash can", "trash", "idiots", "id­iot idiot", "", "1234 $$$ !!!")] == [1, 1, 1, 1, 0, 1, 0, 2, 0, 0]


@pytest.mark.parametrize("kind", ["none", "one class"])
def test_without_labels_the_score_is_defined(llm, kind):
    docs = frame(llm, EDGES)
    rows = [] if kind == "none" else [(i, 1, 0) for i in range(10)] + [(3, None, None), (None, 1, 1), (2, 1, 0)]
    labels = llm.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(docs, module.learn(docs, labels)).collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
        assert module.score(docs.limit(0), module.learn(docs.limit(0), labels)).count() == 0
    got = {r["doc_id"]: r["score"] for r in got}
    assert got[12] == got[13]


def test_quality_dictionaries_see_whole_texts(llm):
    """Texts that only differ beyond their first 4,096 characters; the dictionaries learn the rest, whatever its place."""
    rng = random.Random(3)
    start = "".join(rng.choices("abcdefgh ", k=5000))
    ends = {y: [f"{word}{i}" for i in range(300)] for y, word in ((1, "marble"), (0, "pickle"))}
    docs = frame(llm, [start + " " + " ".join(rng.choices(ends[i % 2], k=1500)) for i in range(120)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    good, bad = quality.learn(docs, labels).texts
    assert b"marble" in good and b"pickle" not in good and b"pickle" in bad and b"marble" not in bad
    some = quality.learn(docs, labels, pieces=3).texts
    assert all(0 < len(t) <= 3 * quality.WINDOW for t in some)


def test_beginnings_of_one_word_are_no_entries():
    strong = {" path": 4.0, " pathe": 4.0, " pathetic ": 4.1, " wort": 4.0, " worthless ": 4.2, " idio": 3.9, " idiot": 3.9, " idiot ": 4.0, " idiots ": 3.0,
              " moro": 3.8, " moron": 3.7, " moron ": 4.0, " moronic ": 3.1, " scum ": 3.5}
    kept = toxicity.chosen(strong)
    assert kept == {" scum ": 3.5, " idiot": 3.9, " moron": 3.7, " pathetic ": 4.1, " worthless ": 4.2}
    table, own = toxicity.folding(), toxicity.Lexicon(kept, (), ()).automaton()
    for text in ("The path to the village is long.", "Ein Wort am Morgen ist gut.", "She moved to Morocco last year.", "That idiom is common."):
        assert toxicity.hits(toxicity.fold(text, table), own) == [], text
    for text in ("What an 1d10t!", "Idiotic, really.", "m0r0n", "you are p@thetic", "idiot$ all"):
        assert len(toxicity.hits(toxicity.fold(text, table), own)) == 1, text
    assert toxicity.chosen({}) == {}


def test_signs_at_the_end_of_a_word_are_letters():
    table = toxicity.folding()
    assert toxicity.fold("a$$ $tupid! 100 loser@? (what)", table) == " ass stupid losera what "


def test_toxicity_against_a_plain_search(llm):
    """Every hit, exception and score of random texts, found by looking at each place of the folded text."""
    rng = random.Random(8)
    lexicon = toxicity.Lexicon({" idiot": 4.0, " scum ": 3.0, " trash ": 2.0, " idiotic ": 6.0}, ("trash can", "pond scum", "can of trash"), (-2.0, 1.0, 0.5))
    parts = ["idiot", "1d10t", "idiotic", "scum", "pond", "trash", "can", "of", "plain", "words", "100", "\u0456diot", "trash!", "", "scum\u200b"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "trash can of trash " * 20_000]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    look = {"1": "i", "0": "o", "\u0456": "i", "\u200b": "", "!": " "}
    for i, text in enumerate(texts):
        kept = [w for w in (text or "").split() if not w.isdigit()]
        line = " " + " ".join("".join(look.get(c, c) for c in " ".join(kept)).split()) + " "
        spared = set()
        for phrase in lexicon.exceptions:
            at = line.find(f" {phrase} ")
            while at >= 0:
                spared.update(range(at, at + len(phrase) + 1))
                at = line.find(f" {phrase} ", at + 1)
        total, n = 0.0, 0
        for at in range(len(line)):
            if line[at] == " " and at not in spared:
                best = max((w for e, w in lexicon.weights.items() if line.startswith(e, at)), default=None)
                total, n = total + (best or 0.0), n + (best is not None)
        z = -2.0 + math.log1p(total) + 0.5 * math.log1p(1000 * total / max(10, line.count(" ") - 1))
        assert got[i]["n_hits"] == n, text
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
