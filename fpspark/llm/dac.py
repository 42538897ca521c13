"""Token ids in directly addressable codes: random access to any token without decoding a block.

An id is split into chunks of 8 bits, lowest first. Level k holds chunk k of
every id that has one, and a bitmap that says which of them go on to level
k + 1. The place of id i on level k + 1 is the rank (count of set bits) of its
place in level k's bitmap; a directory with the rank before every 512th bit
makes that a look-up and a count within 64 bytes.

Layout of a segment, little-endian: magic ``FPDAC1``, u16 number of levels, u64
number of ids; for each level u64 number of chunks, the chunks, the bitmap
(padded to 64 bytes), and the directory (u64 each). Segments are kept as rows
of a Parquet table (``segments``) beside the offsets of their documents, so
writes are atomic on any store and survive lost tasks; a second one
(``manifest``) says at which place among all ids each segment starts. To get one
token, the manifest names its segment, whose row alone is fetched (about 100
KB), and the codes give it without decoding any other.

Rows are dealt out by ranges of (doc_id, hash of the text), whose bounds come
from a bounded sample, so that rows that repeat a doc_id or lack one can fall
into several ranges. A task streams through its ranges and holds a segment.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import new_path, prepare
from .bpe import WordCodec
from .chunks import Store, encode_texts, slices, text_column

MAGIC, BLOCK = b"FPDAC1", 512
#: Ids after which a segment is closed (with the document it is in), and documents of a range on average.
SEGMENT_IDS, RANGE_DOCS = 1 << 16, 1024
#: Ranges at most (beyond, they have more documents), ranges of a task, and rows of the sample for each bound.
MOST_RANGES, OF_A_TASK, PER_BOUND = 4096, 4, 16
FIRST = -(1 << 63)  # stands for a null doc_id: it comes before all others
_ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_stores: dict[str, Store] = {}


def pack(ids: np.ndarray) -> bytes:
    """The segment of a sequence of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    out, levels = [], 0
    while levels == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        blocks = _ones[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        directory = np.cumsum(blocks, dtype=np.uint64) - blocks
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), directory.astype("<u8").tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    return b"".join([MAGIC, struct.pack("<HQ", levels, len(ids)), *out])


class Segment:
    """Reads a segment in place."""

    def __init__(self, data: bytes):
        if data[:6] != MAGIC:
            raise ValueError("not a segment of token ids")
        levels, self.n = struct.unpack_from("<HQ", data, 6)
        self.levels, at = [], 16
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            n_blocks = -(-n // BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, n_blocks * BLOCK // 8, at + 8 + n)
            directory = np.frombuffer(data, "<u8", n_blocks, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, directory))
            at += 8 + n + len(bits) + 8 * n_blocks
        if at != len(data):
            raise ValueError("the segment of token ids is cut short")

    @staticmethod
    def _rank(level, i: int) -> int:
        """Set bits before place i."""
        _, bits, directory = level
        if i // BLOCK >= len(directory):
            return int(directory[-1]) + int(_ones[bits[-BLOCK // 8 :]].sum()) if len(directory) else 0
        start = i // BLOCK * (BLOCK // 8)
        full = int(_ones[bits[start : i // 8]].sum())
        return int(directory[i // BLOCK]) + full + (int(_ones[bits[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[0][i]) << 8 * k
            if not level[1][i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b - 1: on every level they stand side by side."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for k, level in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= level[0][a:b].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(level[1][a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = where[more]
            a, b = self._rank(level, a), self._rank(level, a) + len(where)
        return out


def worker_store(path: str) -> Store:
    if path not in _stores:
        _stores[path] = Store(WordCodec(path).encode_chunks)
    return _stores[path]


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, key, and ids (binary, little-endian, with the end id) of each document."""

    def run(batches):
        store = worker_store(path)
        for whole in batches:
            for batch in slices(whole):
                offsets, ids = encode_texts(text_column(batch.column(1)), store)
                ended = np.insert(ids, offsets[1:], end_id).astype("<u4")
                places = (offsets + np.arange(len(offsets))) * 4
                small = ended.astype("<u2") if not len(ended) or ended.max() < 1 << 16 else None
                data, places, width = (small, places // 2, 2) if small is not None else (ended, places, 4)
                blobs = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.full(batch.num_rows, width, np.int32)), blobs.cast(pa.binary())], names=["doc_id", "key", "width", "ids"])

    schema = T.StructType([docs.schema["doc_id"], docs.schema["key"], T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text", "key").mapInArrow(run, schema)


def _segments(rows: DataFrame) -> DataFrame:
    """Segments of the documents of each partition, which stand in order: shard, its number in the shard, documents with their places, and the packed ids."""

    def run(batches):
        shard, number, ids, docs, held = None, 0, [], [], 0

        def close():
            flat = np.concatenate(ids)
            places = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([number], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([places.tolist()], pa.list_(pa.int64())), pa.array([pack(flat)], pa.binary())], names=["shard", "number", "n_ids", "doc_ids", "places", "data"])

        for batch in batches:
            for s, d, width, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (s != shard or held >= SEGMENT_IDS):
                    yield close()
                    number, ids, docs, held = number + 1 if s == shard else 0, [], [], 0
                shard = s
                docs.append(d)
                ids.append(np.frombuffer(blob, f"<u{width}").astype(np.uint32))
                held += len(ids[-1])
        if ids:
            yield close()

    long = T.LongType()
    schema = T.StructType([T.StructField("shard", long), T.StructField("number", T.IntegerType()), T.StructField("n_ids", long), T.StructField("doc_ids", T.ArrayType(long)), T.StructField("places", T.ArrayType(long)), T.StructField("data", T.BinaryType())])
    return rows.select("shard", "doc_id", "width", "ids").mapInArrow(run, schema)


def write(docs: DataFrame, path: str, to: str | None = None, end_id: int = 2) -> str:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order; returns the folder.

    A null text counts as empty: it has the end id alone. Rows without a doc_id
    come first. Rows that repeat a doc_id come in the order of a hash of their
    text, then of their ids; rows alike in these are alike in all. Texts of any
    length are written whole. Extra columns are not read; an empty table gives
    files without rows.
    """
    spark = prepare(docs.sparkSession)
    to = to or new_path(spark, "token-ids")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.struct(F.coalesce("doc_id", F.lit(FIRST)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_DOCS)))
    bounds = []
    if ranges > 1:
        sample = sorted(tuple(r.key) for r in docs.select(key.alias("key")).sample(min(1.0, PER_BOUND * ranges / n), seed=1).collect())
        bounds = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)} if sample else set())
    rows = _encoded(docs.withColumn("key", key), path, end_id).withColumn("shard", _range_of(bounds))
    rows = rows.repartition(max(-(-ranges // OF_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "key", "width", "ids")
    _segments(rows).write.parquet(f"{to}/segments")
    # A row per segment, of three numbers: a running sum over ranges, then within each.
    sizes = spark.read.parquet(f"{to}/segments").select("shard", "number", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    start = F.col("shard_start") + F.sum("n_ids").over(Window.partitionBy("shard").orderBy("number")) - F.col("n_ids")
    sizes.join(shards, "shard").select("shard", "number", "n_ids", start.alias("segment_start")).write.parquet(f"{to}/manifest")
    return to


def _range_of(bounds: list[tuple[int, int]]):
    """The number of bounds that are below or at the key, found by halves in a sorted array."""
    if not bounds:
        return F.lit(0).cast("long")
    array = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(h).alias("hash")) for i, h in bounds]) if len(bounds) < 2 else F.from_json(F.lit(json.dumps([{"id": i, "hash": h} for i, h in bounds])), "array<struct<id:bigint,hash:bigint>>")
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length()))),
        F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.element_at(array, middle(s) + 1) <= F.col("key"), F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))),
    )
    return state["lo"].cast("long")


def token(spark: SparkSession, path: str, place: int) -> int:
    """The id at a place among all ids in the files: one row of the manifest, one of the segments, no block decoded."""
    manifest = spark.read.parquet(f"{path}/manifest").filter((F.col("segment_start") <= place) & (F.col("segment_start") + F.col("n_ids") > place)).first()
    if manifest is None:
        raise IndexError(place)
    row = spark.read.parquet(f"{path}/segments").filter((F.col("shard") == manifest.shard) & (F.col("number") == manifest.number)).select("data").first()
    return Segment(bytes(row.data))[place - manifest.segment_start]


def read(spark: SparkSession, path: str) -> DataFrame:
    """What the files in ``path`` hold, a row per document.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and
    last_id, by access to its single place.
    """
    prepare(spark)
    starts = spark.read.parquet(f"{path}/manifest").select("shard", "number", "segment_start")

    def run(batches):
        for batch in batches:
            for docs, places, data, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segment = Segment(data)
                crcs = [zlib.crc32(segment.range(a, b).astype("<u4").tobytes()) for a, b in zip(places[:-1], places[1:], strict=True)]
                at = np.array(places, np.int64)
                last = [segment[b - 1] for b in places[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64()), pa.array(last, pa.int64())], names=NAMES)

    segments = spark.read.parquet(f"{path}/segments").select("shard", "number", "doc_ids", "places", "data")
    return segments.join(starts, ["shard", "number"]).select("doc_ids", "places", "data", "segment_start").mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in NAMES]))


NAMES = ["doc_id", "start", "n_tokens", "ids_crc32", "last_id"]
