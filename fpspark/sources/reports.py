"""Query files in, batch reports out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .compounds import ReaderConfig, read_lines

# The columns of the two reports.
PLAIN = ("query_id", "query_smiles", "rank", "doc_id", "score", "docs_evaluated", "eval_fraction_pct", "error")
RESOLVED = ("query_id", "query_smiles", "rank", "doc_id", "score", "compound_id", "compound_smiles", "mw", "logp", "rot_bonds", "heavy_atoms", "ring_count", "docs_evaluated", "eval_fraction_pct", "error")


def fixed(column: Column, digits: int) -> Column:
    """A number with so many decimals as C and SQL print it: rounded from its exact value, ties to even; null stays.

    Java's formatter rounds the shortest decimal text of a number, ties up.
    """

    def text(values: pd.Series) -> pd.Series:
        return values.map(f"{{:.{digits}f}}".format, na_action="ignore")

    return F.pandas_udf(text, "string")(column.cast("double"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """line, query_id, smiles of a query file: "SMILES [id]" on each line; blank lines and lines that start with # are passed over; the id defaults to Q and the line's number, from 1."""
    lines = read_lines(spark, path, ReaderConfig(has_header=False)).withColumn("text", F.regexp_replace("raw", r"^\s+|\s+$", "")).filter(~F.col("text").startswith("#"))
    parts = F.split("text", r"\s+")
    return lines.select("line", F.coalesce(F.get(parts, F.lit(1)), F.concat(F.lit("Q"), (F.col("line") + 1).cast("string"))).alias("query_id"), F.get(parts, F.lit(0)).alias("smiles"))


def query_error(asked: DataFrame):
    """What is wrong with a query, as text; empty if nothing is."""
    bad = ~((F.col("threshold") >= 0) & (F.col("threshold") <= 1))
    return F.when(F.coalesce(bad, F.lit(True)) | F.isnan("threshold"), "the threshold must be from 0 to 1").when(F.size("bits") == 0, "the query has no bits").otherwise("")


def batch_report(asked: DataFrame, results: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """The plain report, all text: a row per result; a query without results, or in error, has one row with blanks.

    ``asked``: query_id, query_smiles, bits, threshold. ``stats``, if given:
    query_id, docs_evaluated, corpus_size.
    """
    out = asked.withColumn("error", query_error(asked)).select("query_id", "query_smiles", "error").join(results.select("query_id", "rank", "doc_id", "score"), "query_id", "left")
    if stats is not None:
        out = out.join(stats, "query_id", "left")
    else:
        out = out.withColumns({"docs_evaluated": F.lit(None).cast("long"), "corpus_size": F.lit(None).cast("long")})
    pct = F.col("docs_evaluated") / F.greatest(F.col("corpus_size"), F.lit(1)) * 100
    text = {"rank": F.col("rank").cast("string"), "doc_id": F.col("doc_id").cast("string"), "score": fixed(F.col("score"), 4), "docs_evaluated": F.col("docs_evaluated").cast("string"), "eval_fraction_pct": fixed(pct, 6)}
    missing = {"rank": "rank", "doc_id": "rank", "score": "rank", "docs_evaluated": "docs_evaluated", "eval_fraction_pct": "docs_evaluated"}
    return out.select("query_id", "query_smiles", *[F.when(F.col(missing[c]).isNotNull(), text[c]).otherwise("").alias(c) for c in PLAIN[2:7]], "error")


def resolved_report(plain: DataFrame, compounds: DataFrame) -> DataFrame:
    """The plain report with each hit's compound. Hits are few beside compounds: Spark sends them there if they are small."""
    hits = plain.withColumn("_id", F.expr("try_cast(nullif(doc_id, '') as bigint)"))
    known = compounds.select(F.col("doc_id").alias("_id"), "compound_id", F.col("smiles").alias("compound_smiles"), fixed(F.col("mw"), 1).alias("mw"), fixed(F.col("logp"), 2).alias("logp"), *(F.col(c).cast("string").alias(c) for c in ("rot_bonds", "heavy_atoms", "ring_count")))
    known = known.join(hits.filter("_id is not null").select("_id").distinct(), "_id", "left_semi")
    out = hits.join(known, "_id", "left")
    return out.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in RESOLVED])


def write_tsv(report: DataFrame, to: str) -> None:
    report.write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(to)
