"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import chance, fitting_rows, logistic, per_text, ready

FIT_ROWS = 20_000
LEXICON_ROWS = 4_000
STEM = range(4, 8)
FLUSH = 200_000
LEAST_DOCS = 4
LEAST_SHARE = 0.75

# Letters of other scripts that look like Latin ones, and digits and signs used for letters (fixed values).
LOOKALIKES = dict(zip("абвгеорсухіјѕԁһӏкмнтАВЕЅІЈКМНОРСТХУαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "abbreopcyxijsdhlkmhtabesijkmhopctxyabeikvoptuxabezhikmnoptyx", strict=True))
SUBSTITUTES = dict(zip("013457@$!", "oieastasi", strict=True))
# Insults that count even where the labels do not show them (fixed values).
SEEDS = ("idiot", "moron", "scum", "stupid", "worthless", "pathetic", "disgusting", "loser", "trash", "clown")
# Phrases in which a lexicon word is harmless (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "taking out the trash", "class clown fish", "clown fish", "circus clown",
              "sore loser bracket", "loser bracket", "pond scum", "stupid simple", "idiot proof")


def folding() -> dict[int, str]:
    """Translation table: lower case, look-alikes and full-width forms to Latin, substitutes to letters, the rest that is no letter to a blank."""
    table = {}
    for code in range(0x250):
        c = chr(code)
        if c in SUBSTITUTES:
            table[code] = SUBSTITUTES[c]
        elif not c.isalpha():
            table[code] = " "
        elif len(c.lower()) == 1:
            table[code] = c.lower()
    for code in range(0xFF01, 0xFF5F):
        c = chr(code - 0xFEE0)
        table[code] = SUBSTITUTES.get(c, c.lower() if c.isalpha() else " ")
    for code in [*range(0x2000, 0x2070), 0x3000]:
        table[code] = "" if unicodedata.category(chr(code)) == "Cf" else " "
    table[0xAD] = ""
    table |= {ord(a): b for a, b in LOOKALIKES.items()}
    return table


def fold(text: str, table: dict[int, str]) -> str:
    """Words of folded text between single blanks, with a blank at either end.

    A number is dropped first: it is no disguised word. Exclamation marks end a word, ``@`` and ``$`` at its end are letters.
    """
    return " " + " ".join(_worded(text).translate(table).split()) + " "


def _worded(text: str) -> str:
    return " ".join([w if w.isalpha() else w.rstrip("!?*&%#").lstrip("!?*&%#") for w in text.split() if not w.isdigit()])


@dataclass(frozen=True)
class Lexicon:
    """weights: entry to weight, where an entry starts with a blank and, if it is a whole word, ends with one."""
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    beta: tuple[float, ...]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def hits(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """(place, weight) of the matches; at one place the heaviest counts, inside an exception none does."""
    best: dict[int, float] = {}
    spared = []
    for end, (size, weight) in automaton.iter(text) if len(automaton) else ():
        begin = end - size + 1
        if weight is None:
            spared.append((begin, end))
        else:
            best[begin] = max(weight, best.get(begin, 0.0))
    out, reach, at = [], -1, 0
    spared.sort()
    for place, weight in sorted(best.items()):
        while at < len(spared) and spared[at][0] <= place:
            reach = max(reach, spared[at][1])
            at += 1
        if place >= reach:
            out.append((place, weight))
    return out


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float, int]:
    found = hits(folded, automaton)
    total = sum(w for _, w in found)
    return math.log1p(total), math.log1p(1000 * total / max(10, folded.count(" ") - 1)), len(found)


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, entries: int = LEXICON_ROWS, exceptions=EXCEPTIONS, seeds=SEEDS) -> Lexicon:
    """Lexicon and calibration from at most ``rows`` labelled documents outside the held-out fold.

    For whole words and word beginnings, the documents of either label that hold them are counted on the cluster; the
    ``entries`` strongest of which nearly all documents are toxic reach the driver. Whole words are entries. A beginning is
    one only if it is what several of those words have in common, at full length; beginnings of a single word are not, since
    they begin harmless words, too. The calibration is a logistic regression on the summed weight and on its density. Rows
    that share an id are rows of their own; rows without an id or without a label are not learned from.
    """
    ready(docs.sparkSession)
    sample = fitting_rows(docs, labels, "toxic", rows, "toxic-sample")

    def count(batches):
        table, seen = folding(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                mine = set()
                for w in set(fold(text, table).split()):
                    mine.add(f" {w} ")
                    mine.update(f" {w[:n]}" for n in STEM if n <= len(w))
                seen.update((e, y) for e in mine)
                if len(seen) > FLUSH:
                    yield _counts(seen)
                    seen.clear()
        yield _counts(seen)

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    strong = (sample.select("text", "y").mapInArrow(count, "entry string, toxic bigint, clean bigint")
              .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .filter((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
              .orderBy(F.desc("toxic"), F.length("entry"), "entry").limit(entries).collect())
    weights = chosen({r["entry"]: math.log((r["toxic"] + 0.5) / (n1 + 1)) - math.log((r["clean"] + 0.5) / (n0 + 1)) for r in strong})
    heaviest = max(weights.values(), default=5.0)
    weights |= {f" {s} ": heaviest for s in seeds if not _covered(f" {s} ", weights)}
    raw = Lexicon(weights, exceptions, ())

    def measure():
        table, automaton = folding(), raw.automaton()
        return lambda text: features(fold(text, table), automaton)[:2]

    seen = per_text(sample, measure, "total double, density double", keep=("y",)).collect()
    beta = logistic(np.array([[r["total"], r["density"]] for r in seen], dtype=float).reshape(-1, 2), np.array([r["y"] for r in seen], dtype=float))
    return Lexicon(weights, exceptions, tuple(beta.tolist()))


def chosen(strong: dict[str, float]) -> dict[str, float]:
    """Entries to match of the strong words and beginnings: common beginnings of two words or more, and the words left.

    A common beginning is given at full length, with the weight of the longest strong beginning within it.
    """
    words = defaultdict(list)
    for entry in strong:
        if entry.endswith(" "):
            for n in STEM:
                if n + 2 <= len(entry):
                    words[entry[: n + 1]].append(entry)
    stems: dict[str, float] = {}
    for entry in sorted((e for e in strong if not e.endswith(" ")), key=lambda e: (len(e), e)):
        if len(words[entry]) > 1:
            stems[commonprefix(words[entry]).rstrip()] = strong[entry]
    kept: dict[str, float] = {}
    for entry in sorted([*stems, *(e for e in strong if e.endswith(" "))], key=lambda e: (len(e), e)):
        if entry not in kept and not _covered(entry, kept):
            kept[entry] = stems[entry] if entry in stems else strong[entry]
    return kept


def _covered(entry: str, kept: dict[str, float]) -> bool:
    return any(entry[:n] in kept for n in range(STEM[0] + 1, len(entry) + 1))


def _counts(seen: Counter) -> pa.RecordBatch:
    entries = sorted({e for e, _ in seen})
    return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array([seen[e, 1] for e in entries], pa.int64()),
                                       pa.array([seen[e, 0] for e in entries], pa.int64())], names=["entry", "toxic", "clean"])


def score(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, weight and n_hits of every whole text; a NULL or empty text has no hits and the score of none."""
    def make():
        table, automaton = folding(), lexicon.automaton()

        def work(text: str) -> tuple:
            total, density, n = features(fold(text, table), automaton)
            return chance(lexicon.beta, total, density), math.expm1(total), n
        return work
    return per_text(docs, make, "score double, weight double, n_hits bigint", keep)
