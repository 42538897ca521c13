"""Compound files in, compound tables out.

A compound file is text (bzip2 or plain) of tab-separated lines with a header:
SMILES, id, and what else. Lines become rows with a dense doc_id in the order
of path and line, whatever order Spark reads the files in.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.udfs import mol_props, morgan_fp
from ..runtime import materialize, prepare
from ..schema import COMPOUNDS, VERSION

#: Rows of a file of a compound table.
ROWS_PER_FILE = 1_000_000
#: Hits that are broadcast, at most.
SENT = 100_000
TRIM = r"^[\s\x00]+|[\s\x00]+$"


@dataclass(frozen=True)
class ReaderConfig:
    has_header: bool = True
    smiles_col: int = 0
    id_col: int = 1
    strip_cx: bool = False  # cut what follows the first blank of a SMILES field, such as extended notation


@dataclass(frozen=True)
class IngestStats:
    total_lines: int
    parsed_ok: int
    parse_failures: int


def read_lines(spark: SparkSession, path: str | list[str], config: ReaderConfig = ReaderConfig()) -> DataFrame:
    """path, line (0-based, counted with blank lines and header) and raw of every line that is neither blank nor the header.

    A large file is read in blocks, each by one task and in order, so running
    ids rise within a block; counts of the blocks before it do the rest.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    # A block of a file is read by one task, in order: its running ids rise from the block's first one.
    blocks = rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("path", "start", "first", "before")
    out = rows.join(blocks, ["path", "start"]).select("path", (F.col("at") - F.col("first") + F.col("before")).alias("line"), "raw")
    if config.has_header:
        out = out.filter("line > 0")
    return out.filter(~F.col("raw").rlike(r"^\s*$"))


def fields(raw, config: ReaderConfig = ReaderConfig()) -> tuple[Column, Column]:
    """SMILES and id of a line, null where the line has none: the line is trimmed, cut at two tabs at most, and the parts trimmed."""
    parts = F.split(F.regexp_replace(bits.col(raw), TRIM, ""), "\t", 3)
    part = lambda k: F.regexp_replace(F.get(parts, F.lit(k)), TRIM, "")
    smiles, name = part(config.smiles_col), part(config.id_col)
    if config.strip_cx:
        smiles = F.regexp_replace(smiles, r"\s.*$", "")
    return F.when((smiles != "") & name.isNotNull(), smiles), F.when((smiles != "") & name.isNotNull(), name)


def parse(lines: DataFrame, config: ReaderConfig = ReaderConfig()) -> DataFrame:
    """``lines`` with smiles, compound_id and ok: a SMILES of two bytes or more, and an id."""
    smiles, name = fields("raw", config)
    out = lines.withColumns({"smiles": smiles, "compound_id": name})
    return out.withColumn("ok", F.coalesce(F.octet_length("smiles") >= 2, F.lit(False)))


def featurize(rows: DataFrame) -> DataFrame:
    """Compounds from doc_id, compound_id and smiles: properties, fingerprint and its popcount."""
    prepare(rows.sparkSession)
    out = rows.select("doc_id", "compound_id", "smiles", mol_props(F.col("smiles")).alias("p"), morgan_fp(F.col("smiles")).alias("fingerprint"))
    return out.select("doc_id", "compound_id", "smiles", "p.*", "fingerprint", bits.popcount("fingerprint").alias("fp_pop"))


def with_doc_ids(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a dense doc_id from 0 in the given order: counted in ranges, then within each, so no task sees all rows."""
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    sizes = ranged.groupBy("_range").count()
    # a row per range: as many as shuffle partitions
    starts = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(starts), "_range").withColumn("doc_id", (F.col("_start") + within).cast("long")).drop("_range", "_start")


def ingest(spark: SparkSession, path: str | list[str], to: str, config: ReaderConfig = ReaderConfig(), append: bool = False) -> IngestStats:
    """Read compound files, featurize, and write a compound table; a table that exists is an error unless ``append``."""
    lines = materialize(parse(read_lines(spark, path, config), config).select("path", "line", "compound_id", "smiles", "ok"), "lines")
    seen = lines.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok")).first()
    good = with_doc_ids(lines.filter("ok").drop("ok"), "path", "line")
    if append:
        top = spark.read.parquet(to).agg(F.max("doc_id").alias("m")).first().m
        good = good.withColumn("doc_id", F.col("doc_id") + F.lit(-1 if top is None else top) + 1)
    write_compounds(featurize(good.select("doc_id", "compound_id", "smiles")), to, append)
    return IngestStats(seen.total, seen.ok, seen.total - seen.ok)


def write_compounds(compounds: DataFrame, to: str, append: bool = False) -> None:
    """Write the columns of a compound table, and its version beside it."""
    spark = compounds.sparkSession
    compounds.select(*COMPOUNDS.names).write.mode("append" if append else "errorifexists").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(to)
    n = spark.read.parquet(to).count()
    write_meta(spark, to, {"kind": "compounds", "version": VERSION, "rows": n})


def write_meta(spark: SparkSession, to: str, meta: dict) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{to}/_meta.json")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(json.dumps(meta).encode())
    out.close()


def read_meta(spark: SparkSession, path: str) -> dict:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_meta.json")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str, kind: str = "compounds", schema=COMPOUNDS) -> DataFrame:
    """A table of this engine; raises ValueError if its kind, version, columns or number of rows are not what they should be."""
    try:
        meta = read_meta(spark, path)
    except Exception as e:
        raise ValueError(f"{path} is no table of this engine: {e}") from e
    if meta.get("kind") != kind or meta.get("version") != VERSION:
        raise ValueError(f"{path} holds {meta.get('kind')} of version {meta.get('version')}, not {kind} of version {VERSION}")
    out = spark.read.parquet(path)
    missing = [f.name for f in schema if f.name not in out.columns or out.schema[f.name].dataType.simpleString() != f.dataType.simpleString()]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    if out.count() != meta["rows"]:
        raise ValueError(f"{path} is cut short: {meta['rows']} rows were written")
    return out


def take(compounds: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """The compounds of ranked hits, all columns of both. ``hits`` of ``most`` rows at most are sent to the compounds, up to SENT; beyond, Spark chooses."""
    return compounds.join(F.broadcast(hits) if most <= SENT else hits, "doc_id")
