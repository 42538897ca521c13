"""From raw documents to tokenized training data, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; ``run`` writes each stage's rows as Parquet and hands the
next one what it reads back. All stages but the last return the columns of
``documents`` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpspark.llm import bagminhash, bpe_stream, line_dedup, mixing, toxicity
from fpspark.runtime import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Of the mixing stage: how far source, language and topic shares are drawn together (1 leaves them alone).
MIX_POWER = 0.95


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from this input's own labelled rows, rejects go; the rest stays as it is."""
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; n_chars follows. Every document stays, if only with what is left of it."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text").cast("long"), "n_chars").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays. Rows without a doc_id stay."""
    docs = docs.select(*COLUMNS)
    gone = bagminhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics have their target shares of tokens."""
    return mixing.mix_sources(docs.select(*COLUMNS), power=MIX_POWER).select(*COLUMNS)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of decoded text, and the ids themselves."""
    return bpe_stream.encode_decode_digests(docs, WORD_BPE, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Signatures and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
