"""The posting index: a row per set bit of each document, laid out by bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..runtime import materialize, prepare
from ..schema import POSTINGS, VERSION
from ..sources.compounds import ROWS_PER_FILE, read_table, write_meta

#: Documents of a block of a posting list.
BLOCK = 128
#: Stretches of doc_ids in which blocks are looked up.
STRETCHES = 1024


def postings(fps: DataFrame) -> DataFrame:
    """bit, doc_id, pop from rows with doc_id and fingerprint (and fp_pop, else it is counted)."""
    prepare(fps.sparkSession)
    pop = F.col("fp_pop") if "fp_pop" in fps.columns else bits.popcount("fingerprint")
    rows = fps.filter("fingerprint is not null").select("doc_id", pop.cast("int").alias("pop"), "fingerprint")

    def run(batches):
        # as a column expression, looking at 1024 bits of each row is most of a search's time
        for batch in batches:
            words = pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False).reshape(-1, bits.WORDS)
            row, bit = np.nonzero(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(bit, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["bit", "doc_id", "pop"])

    return rows.mapInArrow(run, f"bit int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, pop int")


def postings_of_bits(rows: DataFrame) -> DataFrame:
    """bit, doc_id, pop from distinct rows of doc_id and bit."""
    pops = rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("pop"))
    return rows.join(pops, "doc_id").select("bit", "doc_id", "pop")


def sets_of_bits(rows: DataFrame) -> DataFrame:
    """doc_id, fingerprint, pop from rows of doc_id and bit, which may repeat; pop is that of the rows if they have it, else that of the fingerprint.

    Words are put together as the rows are read, so a row for each document is
    shuffled at most where its bits are together.
    """
    word, one = F.shiftright("bit", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    words = [F.bit_or(F.when(word == w, one).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in range(bits.WORDS)]
    known = [F.max("pop").alias("pop")] if "pop" in rows.columns else []
    out = rows.groupBy("doc_id").agg(*words, *known).withColumn("fingerprint", F.array(*[F.col(f"_w{w}") for w in range(bits.WORDS)]))
    return out.select("doc_id", "fingerprint", F.col("pop") if known else bits.popcount("fingerprint").alias("pop"))


def write_index(fps: DataFrame, to: str) -> None:
    """Write postings by bit, sorted by popcount and doc_id: queries prune bits by folder and popcounts by statistics.

    Bits differ a lot in length, so rows are dealt out by bit and a bucket of
    doc_id, as many buckets as the bit has files: the fullest bit is written by
    many tasks.
    """
    spark = fps.sparkSession
    rows = postings(fps)
    sizes = rows.groupBy("bit").agg(F.ceil(F.count("*") / ROWS_PER_FILE).alias("files"))  # 1024 rows at most
    rows = rows.join(F.broadcast(sizes), "bit").withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.col("files")))
    rows = rows.repartition("bit", "_deal").drop("_deal", "files").sortWithinPartitions("bit", "pop", "doc_id")
    rows.write.mode("errorifexists").partitionBy("bit").parquet(to)
    write_meta(spark, to, {"kind": "postings", "version": VERSION, "rows": spark.read.parquet(to).count()})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "postings", POSTINGS)


def index_stats(post: DataFrame) -> DataFrame:
    """num_compounds (with a bit or more), non_empty_bits, total_postings."""
    return post.agg(F.countDistinct("doc_id").alias("num_compounds"), F.countDistinct("bit").alias("non_empty_bits"), F.count("*").alias("total_postings"))


def blocks(post: DataFrame) -> DataFrame:
    """A row per block of BLOCK documents of a bit's list: base (last doc_id of the block before, 0 for the first), first and last doc_id, documents, least and greatest popcount.

    Places in a list are counted in ranges of (bit, doc_id), then within each:
    no task sees a whole list. What is left for a bit in one task is a row for
    each block.
    """
    ranged = materialize(post.repartitionByRange("bit", "doc_id").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("bit", "_range").agg(F.count("*").alias("n"))
    before = sizes.select("bit", "_range", (F.sum("n").over(Window.partitionBy("bit").orderBy("_range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("bit", "_range").orderBy("doc_id")) - 1
    numbered = ranged.withColumn("place", place).join(before, ["bit", "_range"]).withColumn("block", F.floor((F.col("before") + F.col("place")) / BLOCK).cast("int"))
    out = numbered.groupBy("bit", "block").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.min("pop").alias("min_pop"), F.max("pop").alias("max_pop"))
    return out.withColumn("base", F.coalesce(F.lag("last_doc").over(Window.partitionBy("bit").orderBy("block")), F.lit(0)).cast("long"))


def block_for(block_rows: DataFrame, targets: DataFrame) -> DataFrame:
    """bit, target and the block to look in: the last one whose base is below the target, or the first.

    A block serves the targets above its base up to its last doc_id, the last
    block of a bit all above. Targets meet only the blocks of their stretch of
    doc_ids (STRETCHES of them), not all of their bit.
    """
    width = F.lit(max(1, -(-(targets.agg(F.max("target")).first()[0] or 0) // STRETCHES)))
    stretch = lambda x: F.floor(x / width)
    last = F.max("block").over(Window.partitionBy("bit"))
    spans = block_rows.select("bit", "block", "base", F.when(F.col("block") == last, F.lit((1 << 63) - 1)).otherwise(F.col("last_doc")).alias("end"))
    spans = spans.withColumn("stretch", F.explode(F.sequence(F.least(stretch(F.col("base")), F.lit(STRETCHES)), F.least(stretch(F.col("end")), F.lit(STRETCHES)))))
    asked = targets.withColumn("stretch", F.least(stretch(F.col("target")), F.lit(STRETCHES)))
    met = asked.join(spans, ["bit", "stretch"], "left").filter((F.col("block").isNotNull()))
    found = met.filter((F.col("base") < F.col("target")) & (F.col("target") <= F.col("end"))).select("bit", "target", "block").distinct()
    known = block_rows.select("bit").distinct()
    return targets.join(known, "bit", "left_semi").distinct().join(found, ["bit", "target"], "left").select("bit", "target", F.coalesce("block", F.lit(0)).alias("block"))


def cumulative_bounds(block_rows: DataFrame, p) -> DataFrame:
    """bit, block and bound: the ratio for the greatest popcount of the block and all after it."""
    rest = Window.partitionBy("bit").orderBy("block").rowsBetween(0, Window.unboundedFollowing)
    return block_rows.select("bit", "block", block_bound(F.max("max_pop").over(rest), p).alias("bound"))


def block_bound(max_pop, p):
    """The ratio of a block's greatest popcount to the query's: no upper bound on scores within the block, so nothing is pruned by it."""
    return bits.upper_bound(max_pop, p)


def verify(post: DataFrame, fps: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: documents with bits on both sides, those whose popcounts differ or that one side lacks, and whether all is well.

    ``sample``: only documents with a doc_id below it.
    """
    pop = F.col("fp_pop") if "fp_pop" in fps.columns else bits.popcount("fingerprint")
    left = post.groupBy("doc_id").agg(F.count("*").cast("int").alias("counted"), F.max("pop").alias("stored"))
    right = fps.select("doc_id", pop.alias("pop")).filter("pop > 0")
    if sample is not None:
        left, right = left.filter(F.col("doc_id") < sample), right.filter(F.col("doc_id") < sample)
    both = left.join(right, "doc_id", "full")
    bad = ~(F.col("counted").eqNullSafe(F.col("pop")) & F.col("stored").eqNullSafe(F.col("pop")))
    return both.agg(F.count("*").alias("n_docs"), F.count_if(bad).alias("n_mismatches")).withColumn("ok", F.col("n_mismatches") == 0)


def mismatches(post: DataFrame, fps: DataFrame, most: int = 10) -> DataFrame:
    """At most ``most`` documents whose popcounts differ, by doc_id."""
    left = post.groupBy("doc_id").agg(F.count("*").cast("int").alias("counted"))
    right = fps.select("doc_id", bits.popcount("fingerprint").alias("pop")).filter("pop > 0")
    return left.join(right, "doc_id", "full").filter(~F.col("counted").eqNullSafe(F.col("pop"))).orderBy("doc_id").limit(most)
