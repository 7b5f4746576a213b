"""The operators as queries over the driver tables, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.llm import backtrack, bpe, caps, hpy, license, minhash, packing, pii, quality, repair, topk, toxicity, whitening
from grainwise.llm.common import per_text, remainder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _held(of: int, is_: int):
    return (remainder(F.col("doc_id"), of) == is_).alias("held_out")


@_query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded by the public ranks."""
    return bpe.encode(_table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


@_query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices in every text."""
    return license.scan(_table(spark, folder, "documents")).drop("spans")


@_query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as one stream of ids, cut into full sequences."""
    return packing.pack(_table(spark, folder, "documents"), WORD_BPE).drop("ids")


def _listed(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


@_query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text; the labelers are weighed over all documents first."""
    docs = _table(spark, folder, "documents")
    model = pii.learn(docs)

    def make():
        def work(text: str) -> tuple:
            base, found = pii.spans(text, model)
            return (*[sum(k == kind for k, *_ in base) for kind in pii.BASE], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found))
        return work
    return per_text(docs, make, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


@_query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every text."""
    docs = _table(spark, folder, "documents")
    lexicon = toxicity.learn(docs, _table(spark, folder, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "n_hits")


@_query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score for every text."""
    docs = _table(spark, folder, "documents")
    model = quality.learn(docs, _table(spark, folder, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "text_difference")


@_query
def op3_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every text scored by a hierarchical Pitman-Yor model of the documents that are not held out."""
    docs = _table(spark, folder, "documents")
    scored, model = hpy.model_scores(docs, remainder(F.col("doc_id"), 5) == 1)
    return scored.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("held")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@_query
def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector."""
    return topk.top_k(_table(spark, folder, "embeddings"))


@_query
def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of texts with similar sets of four-word shingles."""
    return minhash.near_copies(_table(spark, folder, "documents"), words=4, percent=80)


@_query
def op9_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of vectors with a cosine of 0.9 or more."""
    return caps.near_copies(_table(spark, folder, "embeddings"))


@_query
def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged by a hash of its rows and repaired at the least cost."""
    rows, copies = repair.damaged(_table(spark, folder, "conversations"))
    return repair.repair(rows, copies)


@_query
def op12_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded by merges with word ends and decoded."""
    return backtrack.digests(_table(spark, folder, "documents"), WORD_BPE)


@_query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the eight strongest components of all vectors, with unit variance."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL"

SQL["op6_top_k"] = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_GOOD}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

SQL["op7_minhash"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \\t-\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, b FROM r),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id"""

SQL["op9_caps"] = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, b FROM r),
f AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, least(d.vec_id, coalesce(f.b, d.vec_id)) AS component_id, d.vec_id = least(d.vec_id, coalesce(f.b, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN n ON n.a = d.vec_id LEFT JOIN f ON f.a = d.vec_id"""

# CRC-32 by its generator, bit by bit, for short ASCII texts. Repair goes row by row through the states of a legal conversation.
SQL["op11_repair"] = r"""
WITH RECURSIVE octets AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b)) AS t),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (SELECT given.*, xor(4294967295, list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS fault FROM given, octets),
convs AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
said AS (SELECT k, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed JOIN convs ON hashed.conv_id IS NOT DISTINCT FROM convs.conv_id, (SELECT unnest(range(2)) AS copy) WHERE copy < CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS pos FROM said),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS f, lag(role) OVER (PARTITION BY k ORDER BY pos) AS before FROM placed),
step(q, c, q2, role) AS (VALUES (0, 's', 1, 'system'), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ins(q, q2, cost, audit, lines) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']),
  (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
edit AS (SELECT k, pos, q, q AS q2, 3 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS lines FROM faults, (SELECT unnest(range(4)) AS q)
  UNION ALL SELECT k, pos, q, q2, CAST(f = 'truncated' AS INTEGER), 'K', [faults.role || ':' || text] FROM faults JOIN step ON left(faults.role, 1) = c WHERE f NOT IN ('blank', 'duplicate')
  UNION ALL SELECT k, pos, q, q2, 2 + CAST(f = 'truncated' AS INTEGER), 'R', [step.role || ':' || text] FROM faults, step WHERE c <> 's' AND f NOT IN ('blank', 'duplicate')),
way AS (SELECT k, CAST(0 AS BIGINT) AS pos, 0 AS q, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS w FROM convs
  UNION ALL
  SELECT way.k, edit.pos, edit.q2, min({'cost': CAST(w.cost + ins.cost + edit.cost AS INTEGER), 'audit': w.audit || ins.audit || edit.audit, 'lines': list_concat(list_concat(w.lines, ins.lines), edit.lines)})
  FROM way JOIN ins ON ins.q = way.q JOIN edit ON edit.k = way.k AND edit.pos = way.pos + 1 AND edit.q = ins.q2 GROUP BY way.k, edit.pos, edit.q2),
ends AS (SELECT convs.k, coalesce(max(pos), 0) AS n FROM convs LEFT JOIN faults USING (k) GROUP BY convs.k),
best AS (SELECT way.k, min({'cost': w.cost + ins.cost, 'audit': w.audit || ins.audit, 'lines': list_concat(w.lines, ins.lines)}) AS w
  FROM way JOIN ends ON ends.k = way.k AND way.pos = ends.n JOIN ins ON ins.q = way.q AND ins.q2 IN (0, 3) GROUP BY way.k),
counted AS (SELECT k, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
  count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(w.cost AS BIGINT) AS cost, w.audit AS audit, sha256(array_to_string(w.lines, chr(10))) AS repaired_sha256
FROM convs JOIN best USING (k) LEFT JOIN counted USING (k)"""
