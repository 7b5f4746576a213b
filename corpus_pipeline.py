"""Documents to training sequences: quality, toxicity, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.llm import minhash, packing, pii, quality, toxicity
from grainwise.llm.common import per_text, stored
from grainwise.llm.queries import WORD_BPE

# The columns of documents; every stage but the last returns them, whatever else its input has.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score is 0.3 or more; the model is fitted on labelled documents among the input."""
    model = quality.learn(docs, _labels(spark, sf_dir))
    return quality.score(docs, model, COLUMNS).filter("score >= 0.3").select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lexicon score is below 0.5."""
    lexicon = toxicity.learn(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, lexicon, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of texts that hang together by similar sets of five-word shingles.

    Different texts that share an id are no copies and stay; rows without an id stay.
    """
    return minhash.one_of_each(docs, words=5, percent=80, keep=COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found span replaced by its kind; n_chars counts the new text. A NULL text stays NULL."""
    model = pii.learn(docs)
    keep = ("doc_id", "lang", "source", "missing")

    def make():
        return lambda text: (pii.redact(text, pii.spans(text, model)[1]),)
    clean = per_text(docs.withColumn("missing", F.col("text").isNull()), make, "clean string", keep)
    return (clean.withColumn("text", F.when(~F.col("missing"), F.col("clean")))
            .withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("quality", good_quality), ("toxicity", not_toxic), ("near_copies", one_of_each_group),
    ("personal_data", without_personal_data), ("packing", packed),
]
# Compressed sizes, trained scores and token ids are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
