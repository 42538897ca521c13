"""Fingerprints and molecules made from tables that hold none, by fixed rules.

E: embeddings - a bit for each coordinate that is large enough, by its size.
D: documents - a bit for each distinct token, by its MD5.
M: parts - molecules put together from a framework and two substituents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Frameworks with places for two substituents, and substituents written from their bond on.
CORES = ("c1ccc({b})cc1{a}", "c1cnc({b})cc1{a}", "C1CCC({b})CC1{a}", "c1ccc2cc({b})ccc2c1{a}", "C1CC({b})C1{a}", "c1cc({b})oc1{a}", "C1C({b})C1{a}", "C1CCC({b})C1{a}", "C1CN({b})CCN1{a}", "CC({b})C{a}")
SUBSTITUENTS = ("C", "CC", "OC", "Cl", "F", "N", "CO", "Br", "C#N", "CCC")
ACYCLIC = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, bit (distinct) of fixture E."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("i", "e"))
    e = F.col("e").cast("double")
    level = F.least(F.lit(15), F.greatest(F.lit(0), F.floor((e + 0.6) / 0.075).cast("int")))
    return rows.filter(F.abs(e) > 0.12).select("doc_id", (F.col("i") * 16 + level).cast("int").alias("bit"))


def document_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, bit (distinct) of fixture D."""
    return document_bit_rows(spark, sf_dir).distinct()


def document_bit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, bit of fixture D, a row for each distinct token: bits repeat."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \n]+"))).alias("token")).filter("token <> ''")
    return tokens.select("doc_id", (F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long") % 1024).cast("int").alias("bit"))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, compound_id, smiles, core (number of the framework), a and b (substituents) of fixture M."""
    part = table(spark, sf_dir, "part")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k)
    core = (F.col("p_partkey") % len(CORES)).cast("int")
    a, b = pick(SUBSTITUENTS, (F.col("p_size") % len(SUBSTITUENTS)).cast("int")), pick(SUBSTITUENTS, (F.length("p_name") % len(SUBSTITUENTS)).cast("int"))
    rows = part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("compound_id"), core.alias("core"), a.alias("a"), b.alias("b"))
    return rows.withColumn("smiles", F.replace(F.replace(pick(CORES, F.col("core")), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")))
