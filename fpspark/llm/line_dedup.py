"""Line deduplication by winnowing over line hashes.

A window is a shortest run of lines with at least RUN words, from each line
onwards and from each line backwards. Of every window the line with the least
hash (the last of equals) is its fingerprint, so two documents that share a run
of RUN words or more share a window in it, and that window's fingerprint. A
fingerprint's position is the line it stands on, and how far the windows that
chose it reach from there to both sides. Only positions of fingerprints found in
several places are joined, each with the first place whose lines agree as far as
the window reaches, told by 128 bits of hash over them. A match grows both ways
by the windows that overlap it: the forward and backward windows of a run cover
it from end to end. Lines in a window that stood before are deleted.

What is looked up in the joins is written first, with a row for each key, so
that the engine can split the rows of a hot key over tasks.

So a line goes if, and only if, it lies in a run of consecutive lines with RUN
words or more that also stands at an earlier place: in a document with a
smaller doc_id, or further up in the same one. Blank lines are passed over when
runs are matched and always stay. Lines are equal if their words are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, prepare
from .bagminhash import mix
from .chunks import slices, strings, text_column
from .scratch import Scratch

#: Words that a repeated run must have.
RUN = 50
_G = np.uint64(0x9E3779B97F4A7C15)
FIRST = -(1 << 63)  # stands for a null doc_id: it comes before all others
#: Keys of the two hashes of a line (any two of 16 bytes).
KEYS = ("line hash no. 01", "line hash no. 02")
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number in its text, two hashes and words of each line that has a word."""
    lists = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = pc.replace_substring_regex(lists.flatten(), "[\t-\r ]+", " ")
    flat = pc.utf8_trim(flat, " ")
    words = pc.add(pc.count_substring(flat, " "), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    kept = flat.filter(pa.array(real))
    values = np.array(strings(kept), object)
    one, two = (pd.util.hash_array(values, hash_key=key, categorize=False) if len(kept) else np.zeros(0, np.uint64) for key in KEYS)
    return owner[real], number[real], one, two, words[real]


def windows(owner: np.ndarray, hashes: np.ndarray, others: np.ndarray, words: np.ndarray, run: int = RUN) -> tuple[np.ndarray, ...]:
    """First and last line (places in the arrays), two content hashes and fingerprint's place of each window."""
    n = len(owner)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    total = np.cumsum(words)
    before = total - words
    place = np.arange(n)
    ends = np.searchsorted(total, before + run, side="left")  # forward: least end
    starts = np.searchsorted(before, total - run, side="right") - 1  # backward: greatest start
    forward = ends < n
    forward[forward] = owner[ends[forward]] == owner[place[forward]]
    backward = starts >= 0
    backward[backward] = owner[starts[backward]] == owner[place[backward]]
    a = np.concatenate([place[forward], starts[backward]])
    b = np.concatenate([ends[forward], place[backward]])
    both = np.unique(a * (n + 1) + b)
    a, b = both // (n + 1), both % (n + 1)
    content, check, least, best = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64), np.full(len(a), ~np.uint64(0)), a.copy()
    with np.errstate(over="ignore"):
        for k in range(int((b - a).max(initial=-1)) + 1):  # a window has RUN lines at most
            live = np.flatnonzero(a + k <= b)
            h = hashes[a[live] + k]
            content[live] = mix(content[live] * _G + h)
            check[live] = mix(check[live] * _G + others[a[live] + k])
            lower = h <= least[live]
            least[live[lower]], best[live[lower]] = h[lower], a[live[lower]] + k
    return a, b, content, check, best


def _fingerprints(docs: DataFrame, run: int) -> DataFrame:
    """A row per fingerprint: its hash, the text it is in, its line, and the windows that chose it."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole):
                texts = text_column(batch.column(2))
                owner, number, hashes, others, words = lines_of(texts)
                found = windows(owner, hashes, others, words, run)
                order = np.lexsort((found[0], found[-1]))
                a, b, content, check, best = (x[order] for x in found)
                first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1]))) if len(best) else np.zeros(0, np.int64)
                at = best[first]
                ends = np.append(first, len(best))
                values = pa.StructArray.from_arrays([pa.array(content.view(np.int64)), pa.array(check.view(np.int64)), pa.array(number[a], pa.int32()), pa.array(number[b], pa.int32())], names=["content", "check", "from", "to"])
                rows = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["print", "id", "text_hash", "windows"])

    long = T.LongType()
    window = T.StructType([T.StructField("content", long), T.StructField("check", long), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])
    schema = T.StructType([T.StructField("print", long), T.StructField("id", long), T.StructField("text_hash", long), T.StructField("windows", T.ArrayType(window))])
    return docs.mapInArrow(work, schema)


def repeated_windows(docs: DataFrame, scratch: Scratch, run: int = RUN) -> DataFrame:
    """id, text_hash, from, to of every window whose lines stand at an earlier place. ``docs``: id, text_hash, text."""
    prints = scratch.keep(_fingerprints(docs, run), "fingerprints")
    several = scratch.keep(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "several")
    own = prints.filter(F.size("windows") > 1).select(F.explode("windows").alias("w"), "id", "text_hash")  # may repeat within its own windows
    met = prints.filter(F.size("windows") == 1).join(several.hint("merge"), "print", "left_semi").select(F.explode("windows").alias("w"), "id", "text_hash")
    places = own.union(met).select("w.content", "w.check", "id", "text_hash", F.col("w.from").alias("from"), F.col("w.to").alias("to"))
    places = scratch.keep(places, "windows")
    first = places.groupBy("content", "check").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_hash", "from")).alias("first")).filter("n > 1").select("content", "check", "first")
    first = scratch.keep(first, "first")
    later = places.join(first.hint("merge"), ["content", "check"]).filter(F.struct("id", "text_hash", "from") > F.col("first"))
    return later.select("id", "text_hash", "from", "to")


def dedup_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``, and n_lines and n_deleted added.

    A null text stays null with 0 lines; an empty one has one (blank) line. A
    null doc_id comes before all others. Rows that agree in doc_id and text are
    one place and never delete each other; rows of one doc_id with other texts
    come in the order of a hash of the text. Texts of any length are taken
    whole. All columns of ``docs`` are kept, but for its own n_lines and
    n_deleted; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    docs = docs.select(*kept)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), F.xxhash64("text")]
    found = repeated_windows(docs.filter("text is not null").select(key[0].alias("id"), key[1].alias("text_hash"), "text"), scratch, run)
    # At most one window from each line onwards and backwards: the list is bounded by the text.
    spans = found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("from", "to")).alias("_spans"))
    spans = materialize(spans.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans"), "spans")
    scratch.drop()
    # The row is one column while it meets its spans: no name of it can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), key[0].alias("_id"), key[1].alias("_hash"))
    joined = rows.join(spans.hint("merge"), ["_id", "_hash"], "left").select("row", "_spans").select("row.*", F.col("_spans").alias("_spans"))
    at, spans_at = kept.index("text"), len(kept)

    def cut(batches):
        for batch in batches:
            column = batch.column(at)
            n_lines = pc.if_else(pc.is_valid(column), pc.add(pc.count_substring(pc.fill_null(column, ""), "\n"), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            n_deleted = np.zeros(len(column), np.int64)
            some = np.flatnonzero(pc.is_valid(batch.column(spans_at)).to_numpy(zero_copy_only=False)).tolist()
            if some:
                texts = column.to_pylist()
                for i in some:
                    texts[i], n_deleted[i] = _without(texts[i], batch.column(spans_at)[i].as_py())
                column = pa.array(texts, pa.string())
            columns = [column if k == at else batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_deleted)], names=[*kept, "n_lines", "n_deleted"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())])
    return joined.mapInArrow(cut, schema)


def _without(text: str, spans: list[dict]) -> tuple[str, int]:
    """A text without the lines of some spans that have a word, and the number of these."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for s in spans:
        gone[s["from"]] += 1
        gone[s["to"] + 1] -= 1
    gone = np.cumsum(gone) > 0
    left = [x for x, g in zip(lines, gone[:-1].tolist(), strict=True) if not (g and x.strip(BLANKS))]
    return "\n".join(left), len(lines) - len(left)
