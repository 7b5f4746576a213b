"""Quality: Zstandard dictionaries of good and bad text; the normalised difference of compressed sizes becomes a score."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import chance, fitting_rows, logistic, per_text

FIT_ROWS = 10_000
# Pieces of either label, of WINDOW bytes at most, that train the dictionaries.
PIECES = 5_000
DICTIONARY = 64 << 10
# Texts are compressed in windows, else a long text becomes its own dictionary and the two sizes meet.
WINDOW = 4096
LEVEL = 3
# Letters of either case become one letter each and runs of them one sign, so that layout shows whatever the language.
_SHAPE = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(a+|A+|0+)")


def shape(text: bytes) -> bytes:
    return _RUNS.sub(lambda m: m.group()[:1], text.translate(_SHAPE))


@dataclass(frozen=True)
class Model:
    """Dictionaries (good, bad) of texts and of shapes, and the calibration."""
    texts: tuple[bytes, bytes]
    shapes: tuple[bytes, bytes]
    beta: tuple[float, ...]

    def measure(self):
        """A function from a text to (text difference, shape difference, shape ratio, text ratio)."""
        coders = [[_coder(d) for d in pair] for pair in (self.texts, self.shapes)]

        def sizes(data: bytes, pair) -> tuple[int, int]:
            good = bad = 0
            for at in range(0, len(data), WINDOW):
                piece = data[at: at + WINDOW]
                good += len(pair[0].compress(piece))
                bad += len(pair[1].compress(piece))
            return good, bad

        def work(text: bytes) -> tuple[float, float, float, float]:
            if not text:
                return 0.0, 0.0, 0.0, 0.0
            form = shape(text)
            (tg, tb), (sg, sb) = sizes(text, coders[0]), sizes(form, coders[1])
            return 10 * (tb - tg) / max(tb, tg), 10 * (sb - sg) / max(sb, sg), math.log(sg / len(text)), math.log(tg / len(text))
        return work


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL)
    prepared = zstandard.ZstdCompressionDict(content)
    prepared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=prepared)


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, pieces: int = PIECES) -> Model:
    """Dictionaries and calibration from at most ``rows`` labelled documents outside the held-out fold.

    Half of them, by a hash of the id, are cut into pieces of WINDOW bytes, as in scoring, from end to end; of either label the
    ``pieces`` with the smallest hashes of id and piece number train the dictionaries, wherever in a text they are. The other
    half, whole, gives the features of the regression. Without labels of both kinds the score is constant.
    """
    sample = fitting_rows(docs, labels, "quality", rows, "quality-sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0

    def cut():
        return lambda text: ([text[at: at + WINDOW] for at in range(0, len(text), WINDOW)],)
    parts = per_text(sample.filter(half & F.col("y").isin(0, 1)), cut, "parts array<binary>", keep=("doc_id", "y"), raw=True)
    every = parts.select("doc_id", "y", F.posexplode("parts").alias("number", "piece")).withColumn("h", F.xxhash64("doc_id", "number"))
    # At most ``pieces`` of each label reach the driver, WINDOW bytes each.
    taken = {y: [bytes(r["piece"]) for r in every.filter(F.col("y") == y).orderBy("h", "doc_id", "number", "piece").limit(pieces).collect()] for y in (0, 1)}
    texts, shapes = (tuple(_content([f(t) for t in taken[y]]) for y in (1, 0)) for f in (bytes, shape))
    raw = Model(texts, shapes, ())
    seen = per_text(sample.filter(~half), raw.measure, "a double, b double, c double, d double", keep=("y",), raw=True).collect()
    x = np.array([[r["a"], r["b"], r["c"], r["d"]] for r in seen], dtype=float).reshape(-1, 4)
    return Model(texts, shapes, tuple(logistic(x, np.array([r["y"] for r in seen], dtype=float)).tolist()))


def _content(texts: list[bytes]) -> bytes:
    """A dictionary trained by the library; with too few texts, the texts themselves in the order given, that of their hashes."""
    texts = [t for t in texts if t]
    if not texts:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICTIONARY]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score and text_difference of every whole text; NULL and empty texts have differences of zero."""
    def make():
        measure = model.measure()

        def work(text: bytes) -> tuple:
            found = measure(text)
            return chance(model.beta, *found), found[0]
        return work
    return per_text(docs, make, "score double, text_difference double", keep, raw=True)
