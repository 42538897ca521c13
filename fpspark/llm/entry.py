"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe_stream, dac, line_dedup, lm_scores, mixing, multi_index, quality, token_counts, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: The targets of the mixing query: equal shares for languages, square roots of the observed ones for sources, topics a little evened out; half of all tokens.
MIX_POWERS, MIX_BUDGET = {"source": 0.5, "lang": 0.0, "topic": 0.8}, 0.5
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their cell, and how often each stands in the sample; null sources and languages by name."""
    drawn = mixing.mix_sources(table(spark, sf_dir, "documents"), power=MIX_POWERS, budget=MIX_BUDGET)
    return drawn.select("doc_id", *(F.coalesce(c, F.lit(mixing.NULL)).alias(c) for c in ("source", "lang")), "topic", "n_tokens", "expected", "copies")


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_decode_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines before, lines deleted, and the text that stays."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the score to four decimals, and how many words backed off or are in no other document."""
    return lm_scores.score_corpus(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), "n_backed_off", "n_unseen")


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read(spark, dac.write(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index": op1_multi_index,
    "op2_mixing": op2_mixing,
    "op3_bpe_transducer": op3_bpe_transducer,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scores": op7_lm_scores,
    "op8_bagminhash": op8_bagminhash,
    "op9_token_ids": op9_token_ids,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.weights_sql(power=MIX_POWERS, budget=MIX_BUDGET),
    "op7_lm_scores": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS words FROM documents),
one AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (
  SELECT doc_id, i, words[i] AS g1, CASE WHEN i > 1 THEN words[i - 1] || ' ' || words[i] END AS g2,
    CASE WHEN i > 2 THEN words[i - 2] || ' ' || words[i - 1] || ' ' || words[i] END AS g3 FROM one),
c1 AS (SELECT g1, count(*) AS c FROM g GROUP BY ALL),
c2 AS (SELECT g2, count(*) AS c FROM g WHERE g2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT g3, count(*) AS c FROM g WHERE g3 IS NOT NULL GROUP BY ALL),
d1 AS (SELECT doc_id, g1, count(*) AS c FROM g GROUP BY ALL),
d2 AS (SELECT doc_id, g2, count(*) AS c FROM g WHERE g2 IS NOT NULL GROUP BY ALL),
d3 AS (SELECT doc_id, g3, count(*) AS c FROM g WHERE g3 IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*) AS n FROM g),
own AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (
  SELECT g.doc_id, g.i, c1.c - d1.c AS k1, coalesce(c2.c - d2.c, 0) AS k2, coalesce(c3.c - d3.c, 0) AS k3, greatest((SELECT n FROM n) - own.n, 1) AS total
  FROM g JOIN c1 ON g.g1 = c1.g1 JOIN d1 ON g.doc_id = d1.doc_id AND g.g1 = d1.g1 JOIN own ON g.doc_id = own.doc_id
  LEFT JOIN c2 ON g.g2 = c2.g2 LEFT JOIN d2 ON g.doc_id = d2.doc_id AND g.g2 = d2.g2
  LEFT JOIN c3 ON g.g3 = c3.g3 LEFT JOIN d3 ON g.doc_id = d3.doc_id AND g.g3 = d3.g3),
h AS (SELECT *, lag(k1) OVER (PARTITION BY doc_id ORDER BY i) AS h1, lag(k2) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM k),
scored AS (
  SELECT doc_id, CASE WHEN k3 > 0 THEN ln(k3::DOUBLE / h2) ELSE CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
      + CASE WHEN k2 > 0 THEN ln(k2::DOUBLE / h1) ELSE CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END + ln(CASE WHEN k1 > 0 THEN k1 ELSE 0.5 END::DOUBLE / total) END END AS s,
    CASE WHEN (i > 2 AND k3 = 0) OR (i = 2 AND k2 = 0) THEN 1 ELSE 0 END AS fell, CASE WHEN k1 = 0 THEN 1 ELSE 0 END AS unseen FROM h)
SELECT w.doc_id, count(s) AS n_words, round(coalesce(sum(s), 0), 4) AS log_score, coalesce(sum(fell), 0)::BIGINT AS n_backed_off, coalesce(sum(unseen), 0)::BIGINT AS n_unseen
FROM w LEFT JOIN scored ON w.doc_id = scored.doc_id GROUP BY w.doc_id
""",
}
