"""BPE encoding and decoding of whole documents with the transducer of ``bpe``.

A document is taken a piece at a time, cut at blanks, where the pre-tokenizer
holds no state. A piece's chunks go through a store of bounded size that
remembers what chunks encode to; what it lacks goes through the transducer. The
ids of a piece are settled: they go at once to a sink, which counts them, hashes
their decimal digits, and feeds the incremental decoder, whose text is hashed as
it comes. So besides its text nothing of a document is held, however long it is.
Short documents of a batch are one piece each and share its look-ups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import prepare
from .bpe import SurfaceDecoder, TextDecoder, WordCodec
from .chunks import Store, encode_texts, slices, text_column

#: Characters of a piece; a piece without a blank that grows beyond twice that is streamed byte by byte.
PIECE = 1 << 16
_codecs: dict[str, tuple[WordCodec, Store, pa.Array, pa.Array]] = {}


def worker_codec(path: str) -> tuple[WordCodec, Store, pa.Array, pa.Array]:
    """This worker's codec, its chunk store, and the token strings and decimal ids by id."""
    if path not in _codecs:
        codec = WordCodec(path)
        _codecs[path] = (codec, Store(codec.encode_chunks), pa.array(codec.surface), pa.array([str(i) for i in range(len(codec.surface))]))
    return _codecs[path]


class Sink:
    """Takes ids as they settle: their number, and the digests of their decimals and of the decoded text."""

    def __init__(self, surface: pa.Array, decimal: pa.Array):
        self.n, self.writers = 0, [(SurfaceDecoder(table), hashlib.sha256()) for table in (decimal, surface)]

    def feed(self, ids) -> None:
        self.n += len(ids)
        for machine, h in self.writers:
            h.update(machine.feed(ids))

    def close(self) -> tuple[int, str, str]:
        for machine, h in self.writers:
            h.update(machine.close())
        return self.n, *(h.hexdigest() for _, h in self.writers)


def pieces(text: str) -> Iterator[str]:
    """A text cut at blanks into pieces of about PIECE characters; without a blank a piece is longer."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            if cut < at:
                found = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                cut = min(found, default=len(text))
            end = cut
        yield text[at:end]
        at = end + 1


def settled(text: str, codec: WordCodec, store: Store) -> Iterator:
    """The ids of a text, a bounded number at a time."""
    for piece in pieces(text):
        if len(piece) > 2 * PIECE:
            yield from codec.stream(piece)
        else:
            yield encode_texts(pa.array([piece], pa.large_string()), store)[1]


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, Iterator]]:
    """The place of each text, and its ids a bounded number at a time: short texts together, long ones by themselves."""
    codec, store, _, _ = worker_codec(path)
    long = pc.greater(pc.binary_length(texts), PIECE).to_numpy(zero_copy_only=False)
    offsets, ids = encode_texts(texts.filter(pa.array(~long)), store)
    for i, a, b in zip(np.flatnonzero(~long).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield i, iter((ids[a:b],))
    for i in np.flatnonzero(long).tolist():
        yield i, settled(texts[i].as_py(), codec, store)


def encode_decode_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``,
    and ``with_ids`` the ids too (array of int). A null text counts as empty: 0
    tokens and the digests of the empty string. Texts of any length are taken
    whole. Rows that repeat, or lack a doc_id, each give a row, equal ones for
    equal texts; other columns of ``docs`` are not read; an empty table gives an
    empty table.
    """
    prepare(docs.sparkSession)

    def run(batches):
        _, _, surface, decimal = worker_codec(path)
        for whole in batches:
            for batch in slices(whole):
                out: list = [None] * batch.num_rows
                for i, parts in encoded(text_column(batch.column(1)), path):
                    sink, held = Sink(surface, decimal), []
                    for ids in parts:
                        sink.feed(ids)
                        if with_ids:
                            held.append(np.asarray(ids, np.int32))
                    out[i] = (*sink.close(), np.concatenate(held) if held else [])
                columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                if with_ids:
                    columns.append(pa.array([x[3] for x in out], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int), made from ``text``; null and empty texts give an empty array."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c != "ids"]
    at = kept.index("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                out: list = [None] * batch.num_rows
                for i, parts in encoded(text_column(batch.column(at)), path):
                    held = [np.asarray(ids, np.int32) for ids in parts]
                    out[i] = np.concatenate(held) if held else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*kept, "ids"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return docs.select(*kept).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, surface: bool = False) -> DataFrame:
    """``coded`` with a column ``decoded``: the text of ``ids``, or with ``surface`` the token strings; null ids give the empty text."""
    prepare(coded.sparkSession)
    kept = [c for c in coded.columns if c != "decoded"]
    at = kept.index("ids")

    def run(batches):
        codec, _, table, _ = worker_codec(path)
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else []
                parts = (values[k : k + PIECE] for k in range(0, len(values), PIECE))
                if surface:
                    machine = SurfaceDecoder(table)
                    texts.append(b"".join(map(machine.feed, parts)).decode())
                else:
                    machine = TextDecoder(codec)
                    texts.append("".join([*map(machine.feed, parts), machine.close()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    schema = T.StructType([*(coded.schema[c] for c in kept), T.StructField("decoded", T.StringType())])
    return coded.select(*kept).mapInArrow(run, schema)
