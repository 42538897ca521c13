"""Near-duplicates by BagMinHash signatures of the multisets of five-word shingles.

A shingle found w times occupies the weight levels (0, w]. Levels are cut into
dyadic intervals (0, 1], (1, 2], (2, 4], ...; each interval of each shingle is
the root of a hierarchical Poisson process. A process has a next point, at a
time and for one of the signature's components. An interval of more than one
level hands its point to one half, by a fair coin, and starts the other half
from that time on; halves above the weight are dropped. A component keeps the
least time among points whose interval lies within the weight, so two
signatures agree there with the probability of the weighted Jaccard similarity.
Processes whose next point comes after the largest component are given up,
which is what makes long texts cheap. All documents of a batch advance together
in numpy; a process depends on the shingle, the interval and the seed alone.

Signatures are banded; documents that share a band's bucket are candidates, and
exact multiset overlap decides. Buckets with the same members are one. Within a
bucket the head (least id) is held against the others, a join of one row for
each member. What links is a class. The pairs that are left differ in class, so
each has an end outside the bucket's commonest class: those outside are cut
into blocks, and a task holds one block against another, or against a block of
the commonest class, and returns a spanning forest of the links it finds.
Every candidate pair is so decided or known to lie in one class, no pair is a
row of its own, and a class of any size costs rows in proportion to its members
once its head has gathered them. Blocks travel with their texts: compressed,
those are smaller than arrays of shingle hashes.
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
from .chunks import slices, strings, text_column
from .components import components
from .scratch import Scratch

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Documents, and shingles, of a block on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of each distinct shingle of n words; a shorter text is one shingle, a text without words has none."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, "[\t-\r]", " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = coded.dictionary
    hashes = pd.util.hash_array(np.array(strings(words), object), categorize=False)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[codes]
    h = hashes[codes][real]
    offsets = np.concatenate(([0], np.cumsum(real)))[np.concatenate(([0], np.cumsum(counts)))]
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    m = len(h)
    out = np.zeros(m, np.uint64)
    left = np.repeat(offsets[1:], size) - np.arange(m)  # words from here to the end of the text
    with np.errstate(over="ignore"):
        for k in range(n):
            at = min(k, m)
            part = np.zeros(m, np.uint64)
            part[: m - at] = h[at:]
            out = np.where(left > k, mix(out * _G + part + np.uint64(k + 1)), out)
        use = (left >= n) | ((left == np.repeat(size, size)) & (left < n))
        out, owner = out[use], owner[use]
        order = np.argsort(mix(out ^ (owner.astype(np.uint64) * _G)), kind="stable")
    out, owner = out[order], owner[order]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], out[at], np.diff(np.append(at, len(out)))


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, m: int, seed: int = 1) -> np.ndarray:
    """n x m times; rows of texts without shingles are infinite."""
    h = np.full((n, m), np.inf)
    flat = h.reshape(-1)
    size = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        base = mix(elements ^ mix(np.full(1, seed, np.uint64) * _G))
        # roots: level 0 is (0, 1], level j is (2**(j-1), 2**j]
        parts = [(np.arange(len(owner)), np.zeros(len(owner), np.int64), np.ones(len(owner), np.int64))]
        low = 1
        while len(weights) and low < weights.max():
            at = np.flatnonzero(weights > low)
            parts.append((at, np.full(len(at), low, np.int64), np.full(len(at), 2 * low, np.int64)))
            low *= 2
        e, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))

        def fresh(e, lo, hi, start):
            """Processes of intervals from a start on: state, time and component of the first point."""
            state = mix(base[e] + mix((lo.astype(np.uint64) << np.uint64(32)) + hi.astype(np.uint64)))
            return step(state, start, hi - lo)

        def step(state, start, rate):
            state = state + _G
            u = (mix(state) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            x = start - np.log1p(-u) / rate
            return state, x, (mix(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64)

        state, x, k = fresh(e, lo, hi, np.zeros(len(e)))
        limit = np.full(n, np.inf)
        repeat = 1
        while len(e):
            d, w = owner[e], weights[e]
            inside = hi <= w
            np.minimum.at(flat, d[inside] * m + k[inside], x[inside])
            leaf = hi - lo == 1
            # leaves go on by themselves, several points at a time once few are left
            le, ls, lx, llo, lhi = e[leaf], state[leaf], x[leaf], lo[leaf], hi[leaf]
            lk = k[leaf]
            limit = h.max(axis=1)
            for _ in range(repeat):
                keep = lx < limit[owner[le]]
                le, ls, lx, llo, lhi = le[keep], ls[keep], lx[keep], llo[keep], lhi[keep]
                if not len(le):
                    lk = lk[:0]
                    break
                ls, lx, lk = step(ls, lx, 1)
                np.minimum.at(flat, owner[le] * m + lk, lx)
            # intervals give their point to one half and start the other half
            s = np.flatnonzero(~leaf & (x < limit[d]))
            se, ss, sx, sk, slo, shi = e[s], state[s], x[s], k[s], lo[s], hi[s]
            mid = (slo + shi) // 2
            coin = (mix(ss + np.uint64(77)) & np.uint64(1)).astype(bool)
            heir_lo, heir_hi = np.where(coin, mid, slo), np.where(coin, shi, mid)
            other_lo, other_hi = np.where(coin, slo, mid), np.where(coin, mid, shi)
            heir_state = mix(base[se] + mix((heir_lo.astype(np.uint64) << np.uint64(32)) + heir_hi.astype(np.uint64)))
            o_state, ox, ok = fresh(se, other_lo, other_hi, sx)
            e = np.concatenate([le, se, se])
            state, x, k = np.concatenate([ls, heir_state, o_state]), np.concatenate([lx, sx, ox]), np.concatenate([lk, sk, ok])
            lo, hi = np.concatenate([llo, heir_lo, other_lo]), np.concatenate([lhi, heir_hi, other_hi])
            limit = h.max(axis=1)
            keep = (lo < weights[e]) & (x < limit[owner[e]])
            e, state, x, k, lo, hi = (v[keep] for v in (e, state, x, k, lo, hi))
            repeat = min(64, 2 * repeat) if len(e) < 1 << 18 else 1
    h[size == 0] = np.inf
    return h


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys of 64 bits; the band's number is mixed in."""
    bits = np.ascontiguousarray(h).view(np.uint64).reshape(len(h), bands, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, (len(h), bands)).copy()
        for r in range(rows):
            out = mix(out + bits[:, :, r])
    return out.view(np.int64)


def overlap(a: pa.Array, b: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts, exactly: sum of least over sum of greatest counts."""
    (oa, ha, ca), (ob, hb, cb) = shingles(a, n), shingles(b, n)
    size = len(a)
    total = np.bincount(oa, ca, size) + np.bincount(ob, cb, size)
    owner, h, c = np.concatenate([oa, ob]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
    order = np.lexsort((h, owner))
    owner, h, c = owner[order], h[order], c[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
    common = np.bincount(owner[same], np.minimum(c[same], c[same + 1]), size)
    return np.where(total > common, common / np.maximum(total - common, 1), 0.0)


def _features(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, same (equal for equal multisets of shingles), size (shingles) and the keys of the bands."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                owner, h, c = shingles(text_column(batch.column(1)))
                n = batch.num_rows
                with np.errstate(over="ignore"):
                    parts = [mix(h + np.uint64(s)) * c.astype(np.uint64) for s in (11, 23)]
                    same = [np.zeros(n, np.uint64) for _ in parts]
                    for out, part in zip(same, parts, strict=True):
                        np.add.at(out, owner, part)
                keys = band_keys(signatures(owner, h, c, n, bands * rows), bands, rows)
                size = np.bincount(owner, c, n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same[0].view(np.int64)), pa.array(same[1].view(np.int64)), pa.array(size), lists], names=["doc_id", "same1", "same2", "size", "keys"])

    long = T.LongType()
    schema = T.StructType([T.StructField(c, long) for c in ("doc_id", "same1", "same2", "size")] + [T.StructField("keys", T.ArrayType(long))])
    return docs.mapInArrow(run, schema)


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b and their exact similarity."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "ta", 2 << 20):
                j = overlap(text_column(batch.column(2)), text_column(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j)], names=["a", "b", "j"])

    with_b = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, j double")


def _forest(similarity: float):
    def link(rows: pa.Table) -> pa.Table:
        """Two blocks of a bucket, or one with itself: for each text that links to one of another class, the least id its links reach here."""
        rows = rows.combine_chunks()
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        block, rep, label = (rows[c].to_numpy() for c in ("block", "rep", "label"))
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        if not len(left) or not len(right) or len(np.unique(label)) < 2:
            return none
        linked = similar(rows["text"].combine_chunks(), left, right, similarity) & (label[left][:, None] != label[right][None, :])
        rank = np.argsort(np.argsort(rep, kind="stable"))
        least = rank.copy()
        while True:
            before = least.copy()
            for own, other, view in ((left, right, linked), (right, left, linked.T)):
                far = np.where(view, least[other][None, :], len(rep)).min(axis=1)
                least[own] = np.minimum(least[own], far)
            if (least == before).all():
                break
        at = np.flatnonzero(least < rank)
        return pa.table({"a": rep[at], "b": np.sort(rep)[least[at]]})

    return link


def similar(texts: pa.Array, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which texts of ``left`` have a weighted Jaccard similarity of ``similarity`` with which of ``right``, exactly."""
    owner, h, c = shingles(text_column(texts))
    n = len(texts)
    size = np.bincount(owner, c, n)
    # A shingle found w times is w elements, so that the overlap of multisets is that of sets.
    with np.errstate(over="ignore"):
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        element = mix(np.repeat(h, c) + nth.astype(np.uint64) * _G)
    owner = np.repeat(owner, c)
    sides = []
    for part in (left, right):
        place = np.full(n, -1)
        place[part] = np.arange(len(part))
        use = place[owner] >= 0
        sides.append((place[owner[use]], element[use]))
    both = np.intersect1d(sides[0][1], sides[1][1])
    codes = []
    for row, e in sides:
        at = np.minimum(np.searchsorted(both, e), max(len(both) - 1, 0))
        hit = both[at] == e if len(both) else np.zeros(len(e), bool)
        order = np.argsort(at[hit], kind="stable")
        codes.append((row[hit][order], at[hit][order]))
    common = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(both), 4096):
        parts = []
        for (row, at), k in zip(codes, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, (begin, begin + 4096))
            x = np.zeros((k, 4096), np.float32)
            x[row[a:b], at[a:b] - begin] = 1
            parts.append(x)
        common += parts[0] @ parts[1].T
    common = common.astype(np.float64)
    total = size[left][:, None] + size[right][None, :]
    return (common > 0) & (common / np.maximum(total - common, 1) >= similarity)


def _linked(held: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """id and component of the documents that link within the buckets of ``held`` (bucket, rep, size, head, head_size)."""
    bound = F.least("size", "head_size") / F.greatest("size", "head_size")  # the most that multisets of such sizes can agree
    pairs = held.filter((F.col("rep") != F.col("head")) & (bound >= similarity)).select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.keep(_verified(pairs, texts).filter(F.col("j") >= similarity).select("a", "b"), "links")
    classes = components(links)
    # What is left to decide: pairs of different classes, without the heads.
    rest = held.filter(F.col("rep") != F.col("head")).join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", "size", F.coalesce("component", "rep").alias("label"))
    rest = scratch.keep(rest, "rest")
    counts = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    wide = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    of = counts.groupBy("bucket").agg(F.max(F.struct("n", "label", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("labels")).filter("labels > 1")
    of = of.select("bucket", F.col("main.label").alias("main"), wide(F.col("main.n"), F.col("main.size")).alias("inner"), wide(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("outer"))
    # Blocks of the commonest class are numbered from 0 up, those outside it from -1 down.
    main, dealt = F.col("label") == F.col("main"), F.xxhash64("rep")
    placed = rest.join(of, "bucket").withColumn("block", F.when(main, F.pmod(dealt, F.col("inner"))).otherwise(-1 - F.pmod(dealt, F.col("outer"))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(-F.col("outer"), F.when(main, F.lit(-1)).otherwise(F.col("inner") - 1))))
    tiles = placed.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "label")
    met = tiles.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    found = scratch.keep(met.groupBy("bucket", "low", "high").applyInArrow(_forest(similarity), "a long, b long"), "found")
    if found.isEmpty():
        return classes
    return components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of near-duplicates among ``docs`` (doc_id, text).

    Returns one row per distinct doc_id: doc_id, class_id (the least doc_id that
    links reach), kept (doc_id = class_id). Two documents link when the
    multisets of their five-word shingles have a weighted Jaccard similarity of
    ``similarity`` or more, also where it ties with it. A text of one to four
    words is one shingle; null, empty and blank texts link with nothing; texts
    of any length are taken whole. Rows without a doc_id are left out; of rows
    that repeat a doc_id the greatest text counts, null the least. Other
    columns are not read; an empty table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(spark)
    if not texts.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = scratch.keep(texts.groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
    # One representative for each multiset of shingles.
    features = materialize(_features(texts, bands, rows), "features")
    own = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(0).alias("own")
    groups = features.groupBy("same1", "same2", "size", own).agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"))
    banded = scratch.keep(groups.filter("size > 0").select("rep", "size", F.explode("keys").alias("bucket")), "bands")
    # Documents alone in a bucket meet nobody there; of buckets with the same members one is enough.
    several = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("rep", "size")).alias("h"), *[F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in (1, 2)]).filter("n > 1")
    buckets = several.groupBy("n", "h", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("h.rep").alias("head"), F.col("h.size").alias("head_size"))
    held = scratch.keep(banded.join(buckets, "bucket"), "held")
    classes = _linked(held, texts, similarity, scratch)
    named = groups.drop("keys").join(classes, F.col("rep") == F.col("id"), "left").select("same1", "same2", "size", "own", F.coalesce("component", "rep").alias("class_id"))
    members = features.select("doc_id", "same1", "same2", "size", own)
    out = members.join(named, ["same1", "same2", "size", "own"])
    scratch.drop()
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
