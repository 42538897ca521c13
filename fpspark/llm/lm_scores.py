"""Stupid-backoff scores of documents from n-gram counts of the corpus.

S(w | h) = c(h w) / c(h) if c(h w) > 0, else BACKOFF * S(w | h'), with h' the
history without its first word, and S(w) = c(w) / N at the end; a word that was
never seen counts half a time. A document's score is the sum of ln S over its
words; its first words have shorter histories.

``score_against`` is the general operator: n-grams exploded to rows, count
tables keyed and partitioned by the n-gram's hash, one left join for each
order, a sum per document. It scores any documents against any counts.

``score_corpus`` scores each document of a corpus by the counts of all others,
so that n-grams of its own alone are not known and back off. It is the same
join with rows packed: a slice of the documents explodes into its distinct
n-grams of all orders, keyed by hash and dealt out by ranges of the hash as
sorted, delta-coded arrays. A range counts its n-grams over all slices and
answers each slice with the counts that the other slices add, in the slice's own
order. The slice then knows the count of each of its n-grams, takes away each
document's own, backs off and sums. Slices and ranges have a size of their own,
so their numbers grow with the corpus. Keys have 56 bits: of n distinct
n-grams a share of n / 2**56 falls together with another (1e-4 at 1e13).
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import new_path, prepare
from .bagminhash import mix
from .chunks import slices, strings, text_column
from .quality import Split

BACKOFF, ORDER = 0.4, 3
#: Bytes of text of a slice, and of those that a range of hashes counts for.
SLICE_BYTES, RANGE_BYTES = 6 << 20, 4 << 20
KEY_BITS = 56
SLICES = "slice long, ids array<long>, n_bytes long, n_words long, ends array<long>, data binary"
_G = np.uint64(0x9E3779B97F4A7C15)


def words_of(text) -> F.Column:
    """The words of a text column, as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+"), lambda w: w != "")


def exploded(docs: DataFrame, order: int) -> DataFrame:
    """A row per word of each document: doc_id, pos, and g1..g_order, the n-grams that end there (null where too short)."""
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    one = words.select("doc_id", "words", F.posexplode("words").alias("pos", "word"))
    grams = [F.when(F.col("pos") >= k, F.array_join(F.slice("words", F.col("pos") - k + 1, k + 1), " ")).alias(f"g{k + 1}") for k in range(order)]
    return one.select("doc_id", "pos", *grams)


def count_table(corpus: DataFrame, order: int = 2) -> DataFrame:
    """n (words), key (xxhash64), gram and count of every n-gram up to ``order``."""
    rows = exploded(corpus, order)
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.col(f"g{k}").alias("gram")) for k in range(1, order + 1)])).alias("x")).select("x.*").filter("gram is not null")
    return stacked.groupBy("n", F.xxhash64("gram").alias("key"), "gram").agg(F.count("*").alias("count"))


def score_against(docs: DataFrame, counts: DataFrame, order: int = 2, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score of every document that has words, against a count table.

    A word that the table lacks altogether is taken to have been seen half a
    time. Documents without words have 0 words and score 0. Rows that share a
    doc_id are scored together; a null doc_id is a doc_id of its own.
    """
    rows = exploded(docs, order)
    total = counts.filter("n = 1").agg(F.sum("count").cast("double").alias("total"))
    wanted = {f"g{k}": k for k in range(1, order + 1)}
    rows = rows.withColumns({f"h{k}": F.when(F.col(f"g{k + 1}").isNotNull(), F.regexp_replace(f"g{k + 1}", r" [^ ]*$", "")) for k in range(1, order)})
    wanted |= {f"h{k}": k for k in range(1, order)}
    for name, n in wanted.items():
        part = counts.filter(F.col("n") == n).select(F.col("key").alias(f"k_{name}"), F.col("gram").alias(f"gram_{name}"), F.col("count").alias(f"c_{name}"))
        rows = rows.join(part, (F.xxhash64(name) == F.col(f"k_{name}")) & (F.col(name) == F.col(f"gram_{name}")), "left").drop(f"k_{name}", f"gram_{name}")
    rows = rows.withColumn("total", F.lit(float(total.first().total or 1)))
    s = F.coalesce("c_g1", F.lit(0.5)) / F.col("total")
    for k in range(2, order + 1):
        s = F.when(F.col(f"c_g{k}").isNotNull(), F.col(f"c_g{k}") / F.col(f"c_h{k - 1}")).when(F.col(f"g{k}").isNotNull(), backoff * s).otherwise(s)
    scored = rows.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.ln(s)).alias("log_score"))
    ids = docs.select("doc_id").distinct()
    joined = ids.join(scored.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))


def coded(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


class Grams:
    """The n-grams of a slice: for each order and word the place of the n-gram that ends there, among the sorted distinct keys."""

    def __init__(self, texts: pa.Array, order: int):
        split = Split.of(texts)
        n_words = np.diff(split.offsets)
        self.order, self.n_words, self.owner = order, n_words, split.owner()
        self.at = np.arange(len(split.codes)) - np.repeat(split.offsets[:-1], n_words)  # the word's place in its text
        words = pd.util.hash_array(np.array(strings(split.words), object), categorize=False)[split.codes] if len(split.codes) else np.zeros(0, np.uint64)
        grams, parts = words, []
        with np.errstate(over="ignore"):
            for k in range(order):
                if k:
                    longer = np.zeros(len(words), np.uint64)
                    longer[k:] = mix(grams[k - 1 : -1] * _G + words[k:] + np.uint64(k))
                    grams = longer
                parts.append(mix(grams + np.uint64(k))[self.at >= k] >> np.uint64(64 - KEY_BITS))
        self.keys, places, self.counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        self.places, begin = [], 0
        for k, part in enumerate(parts):
            place = np.full(len(words), -1)
            place[self.at >= k] = places[begin : begin + len(part)]
            self.places.append(place)
            begin += len(part)

    def score(self, others: np.ndarray, total: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ln S of each word, how often it backed off, and whether no other text has it. ``others``: counts outside the slice; ``total``: words of the corpus."""
        everywhere = others + self.counts
        known = []  # counts of each order outside the word's own text
        for k in range(self.order):
            there = np.flatnonzero(self.at >= k)
            pair = self.owner[there] * np.int64(len(self.keys) + 1) + self.places[k][there]
            _, which, own = np.unique(pair, return_inverse=True, return_counts=True)
            count = np.zeros(len(self.at), np.int64)
            count[there] = everywhere[self.places[k][there]] - own[which]
            known.append(count)
        all_words = np.maximum(total - self.n_words[self.owner], 1)
        s = np.log(np.where(known[0] > 0, known[0], 0.5) / all_words)
        falls = np.zeros(len(s), np.int64)
        for k in range(1, self.order):
            hit = known[k] > 0
            before = np.ones(len(s))
            before[1:] = np.maximum(known[k - 1][:-1], 1)  # the history is the n-gram that ends one word before
            tried = self.at >= k
            s = np.where(hit, np.log(np.maximum(known[k], 1) / before), s + tried * math.log(backoff))
            falls = np.where(hit, 0, falls + tried)
        return s, falls, known[0] <= 0


def _sliced(docs: DataFrame) -> DataFrame:
    """A row per slice: its number, doc_ids, bytes of its texts, words, ends of the texts and the texts, compressed."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            number += 1
            texts = text_column(batch.column(1))
            data = [t.encode("utf-8", "surrogatepass") for t in strings(texts)]
            ends = np.cumsum([len(x) for x in data])
            words = int(np.diff(Split.of(texts).offsets).sum())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([int(ends[-1])], pa.int64()), pa.array([words], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([zstandard.compress(b"".join(data), 9)], pa.binary())], names=["slice", "ids", "n_bytes", "n_words", "ends", "data"])

    return docs.mapInArrow(run, SLICES)


def _texts(ends: list[int], data: bytes) -> pa.Array:
    places = np.concatenate(([0], np.array(ends, np.int64)))
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(zstandard.decompress(data) if len(data) else b"")])


def score_corpus(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score, n_backed_off, n_unseen of every row of ``docs`` (doc_id, text), by the counts of all other rows.

    n_backed_off: words that fell back to a shorter n-gram; n_unseen: words
    that no other row has. A null, empty or blank text has 0 words and score 0;
    texts of any length are taken whole, and equal texts know each other. Rows
    that share a doc_id are documents of their own, and are summed; so are rows
    without one. Sums tie where texts do. Other columns are not read; an empty
    table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    # Bucketed by slice, the table meets the answers where it lies: texts are not shuffled.
    path, name = new_path(spark, "slices"), f"slices_{uuid.uuid4().hex}"
    sliced = _sliced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sliced.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice").option("path", path).option("compression", "none").saveAsTable(name, format="parquet")
    table = spark.table(name)
    size = table.agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_words").alias("n_words")).first()
    ranges, total = max(1, math.ceil((size.n_bytes or 0) / RANGE_BYTES)), size.n_words or 0
    bounds = np.array([(k << KEY_BITS) // ranges for k in range(1, ranges)], np.uint64)

    def pack(batches):
        for batch in batches:
            for number, ends, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = Grams(_texts(ends, data), order)
                places = np.concatenate(([0], np.searchsorted(grams.keys, bounds), [len(grams.keys)]))
                used = np.flatnonzero(np.diff(places)).tolist()
                keys = [coded(np.diff(grams.keys[places[r] : places[r + 1]], prepend=np.uint64(0))) for r in used]
                counts = [coded(grams.counts[places[r] : places[r + 1]]) for r in used]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(used), pa.int64()), pa.array(used, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["slice", "range", "keys", "counts"])

    def join(rows: pa.Table) -> pa.Table:
        """One range: for each slice what the others count of its n-grams."""
        keys = [np.cumsum(decoded(x), dtype=np.uint64) for x in rows["keys"].to_pylist()]
        counts = [decoded(x).astype(np.int64) for x in rows["counts"].to_pylist()]
        which = np.unique(np.concatenate(keys), return_inverse=True)[1]
        flat = np.concatenate(counts)
        sums = np.zeros(int(which.max()) + 1, np.int64)
        np.add.at(sums, which, flat)
        others = np.split(sums[which] - flat, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"slice": rows["slice"], "range": rows["range"], "others": pa.array([coded(x) for x in others], pa.binary())})

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        """One slice: its texts, and the answers of the ranges."""
        ends = own["ends"][0].as_py()
        grams = Grams(_texts(ends, own["data"][0].as_py()), order)
        order_of = np.argsort(answers["range"].to_numpy())
        parts = [decoded(answers["others"][int(i)].as_py()).astype(np.int64) for i in order_of]
        s, falls, unseen = grams.score(np.concatenate([np.zeros(0, np.int64), *parts]), total, backoff)
        n = len(ends)
        return pa.table({"doc_id": pa.array(own["ids"][0].as_py(), pa.int64()), "n_words": grams.n_words.astype(np.int64), "log_score": np.bincount(grams.owner, s, n), "n_backed_off": np.bincount(grams.owner[falls > 0], minlength=n).astype(np.int64), "n_unseen": np.bincount(grams.owner[unseen], minlength=n).astype(np.int64)})

    keyed = table.select("slice", "ends", "data").mapInArrow(pack, "slice long, range long, keys binary, counts binary")
    answers = keyed.groupBy("range").applyInArrow(join, "slice long, range long, others binary")
    scored = table.select("slice", "ids", "ends", "data").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, "doc_id long, n_words long, log_score double, n_backed_off long, n_unseen long")
    out = scored.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "log_score", "n_backed_off", "n_unseen")])
    out.schema  # the plan knows its files by now: the name can go, the files stay
    spark.sql(f"DROP TABLE {name}")
    return out
