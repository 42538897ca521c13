"""Resumable ingest: compound files are parsed and featurized as they arrive, and each only once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import bits
from ..functions.udfs import mol_props, morgan_fp
from ..runtime import prepare
from ..sources.compounds import ReaderConfig, fields, with_doc_ids, write_compounds


def parsed_stream(spark: SparkSession, folder: str, config: ReaderConfig = ReaderConfig(), files_per_trigger: int = 100) -> DataFrame:
    """path, compound_id, smiles of the good lines of files as they come to ``folder``.

    A stream has no line numbers, so a header is told by its text: the first
    field is "smiles" in any case. Files are taken some at a time, which bounds
    what is under way.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    smiles, name = fields("raw", config)
    out = lines.select("path", smiles.alias("smiles"), name.alias("compound_id")).filter("octet_length(smiles) >= 2")
    return out.filter(F.lower("smiles") != "smiles") if config.has_header else out


def start_ingest(spark: SparkSession, folder: str, to: str, checkpoint: str, config: ReaderConfig = ReaderConfig(), once: bool = True) -> StreamingQuery:
    """Featurize arriving files into Parquet at ``to``; with ``once`` the query ends when all there is was read.

    Rows have no doc_id yet: ``finish`` makes a compound table of what is there.
    """
    prepare(spark)
    rows = parsed_stream(spark, folder, config).select("path", "compound_id", "smiles", mol_props(F.col("smiles")).alias("p"), morgan_fp(F.col("smiles")).alias("fingerprint"))
    rows = rows.select("path", "compound_id", "smiles", "p.*", "fingerprint", bits.popcount("fingerprint").alias("fp_pop"))
    writer = rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def finish(spark: SparkSession, streamed: str, to: str) -> None:
    """A compound table, which searches can read, from what a stream has written: ids are dense in the order of path and compound_id."""
    prepare(spark)
    rows = with_doc_ids(spark.read.parquet(streamed), "path", "compound_id", "smiles")
    write_compounds(rows.drop("path"), to)
