"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled.

Tier one is a broadcast table from frequent chunks to their number of tokens,
taken from a bounded sample of documents: it changes the speed, never a count.
It is three flat arrays, 18 bytes an entry: sorted hashes of the chunks, a
second hash that must agree too, and the numbers. Tier two is the worker's own
store, which encodes what the table lacks once.

A chunk is what stands between two blanks, with the blank before it. Where no
blank is followed by white space, the pre-tokenizer's pattern never reaches
across such a blank, so the chunks of a text count on their own. Other texts,
and those with an added token in them, are counted as a whole by the library, in
neither tier (none of the test tables' texts).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import prepare
from .chunks import slices, split, strings, text_column

#: Documents, and characters of each, that the first tier is taken from, and its entries at most.
SAMPLE_DOCS, SAMPLE_CHARS, TABLE = 1000, 4096, 20_000
#: Chunks that a worker remembers, and characters of the longest that it keeps.
REMEMBERED, LONGEST = 400_000, 64
#: Keys of the table's two hashes (any two of 16 bytes).
KEYS = ("chunk hash no. 1", "chunk hash no. 2")
_counters: dict[str, _Counter] = {}


class Table:
    """Numbers of tokens of chunks, by 128 bits of hash."""

    def __init__(self, chunks: list[str], counts: np.ndarray):
        one, two = (self.hashes(chunks, k) for k in (0, 1))
        order = np.argsort(one, kind="stable")
        self.one, self.two, self.counts = one[order], two[order], counts[order].astype(np.uint16)

    @staticmethod
    def hashes(chunks: list[str], k: int) -> np.ndarray:
        return pd.util.hash_array(np.array(chunks, object), hash_key=KEYS[k], categorize=False) if len(chunks) else np.zeros(0, np.uint64)

    def find(self, chunks: list[str]) -> np.ndarray:
        """The number of tokens of each chunk, -1 where the table lacks it."""
        if not len(self.one) or not chunks:
            return np.full(len(chunks), -1)
        one, out = self.hashes(chunks, 0), np.full(len(chunks), -1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        hit = np.flatnonzero(self.one[at] == one)
        sure = self.two[at[hit]] == self.hashes([chunks[i] for i in hit.tolist()], 1)
        out[hit[sure]] = self.counts[at[hit[sure]]]
        return out


class _Counter:
    """Counts tokens with the vocabulary file at ``path`` and remembers chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.seen: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def chunks(self, chunks: list[str], first: Table) -> np.ndarray:
        seen, out = self.seen, first.find(chunks)
        rest = np.flatnonzero(out < 0)
        out[rest] = [seen.get(chunks[i], -1) for i in rest.tolist()]
        missing = rest[out[rest] < 0].tolist()
        if len(seen) + len(missing) > REMEMBERED:
            seen.clear()
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for i, e in zip(part, self.library.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = len(e)
                if len(chunks[i]) <= LONGEST:
                    seen[chunks[i]] = len(e)
        return out


def worker_counter(path: str) -> _Counter:
    if path not in _counters:
        _counters[path] = _Counter(path)
    return _counters[path]


def count_texts(texts: pa.Array, counter: _Counter, first: Table) -> np.ndarray:
    """The number of tokens of each text."""
    odd = pc.or_(pc.match_substring_regex(texts, r" [\s\x0b\x1c-\x1f\x85\p{Z}]"), pc.match_substring_regex(texts, r" $"))
    for s in counter.special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    out = np.zeros(len(texts), np.int64)
    odd = odd.to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(odd).tolist():
        out[i] = counter.whole(texts[i].as_py())
    plain = texts.filter(pa.array(~odd))
    offsets, flat = split(plain)
    coded = flat.dictionary_encode()
    each = counter.chunks([" " + c for c in strings(coded.dictionary)], first)[coded.indices.to_numpy(zero_copy_only=False)]
    starts = offsets[:-1]
    heads = flat.take(pa.array(starts))  # the first chunk of a text has no blank before it
    each[starts] = counter.chunks(strings(heads), first)
    out[~odd] = np.diff(np.concatenate(([0], np.cumsum(each)))[offsets])
    return out


def frequent_chunks(docs: DataFrame, path: str, n_docs: int = SAMPLE_DOCS, size: int = TABLE) -> Table:
    """The first tier: the most frequent chunks of a bounded sample, with their counts of tokens."""
    texts = docs.select(F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).filter("text is not null").limit(n_docs).collect()
    seen = Counter(c for r in texts for c in r.text.split(" ") if 0 < len(c) <= LONGEST)
    chunks = [" " + c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]
    return Table(chunks, worker_counter(path).chunks(chunks, Table([], np.zeros(0, np.int64))))


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Count the tokens of every whole text with the vocabulary file at ``path``.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per row of
    ``docs``. A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat,
    or lack a doc_id, each give a row, equal ones for equal texts; texts of any
    length are counted whole; other columns are not read; an empty table gives
    an empty table.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = spark.sparkContext.broadcast(frequent_chunks(docs, path))

    def run(batches):
        counter, first = worker_counter(path), table.value
        for whole in batches:
            for batch in slices(whole):
                texts = text_column(batch.column(1))
                n = count_texts(texts, counter, first)
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.mapInArrow(run, schema)
