"""Exact similarity search over postings or fingerprints.

All plans give the same rows: every document that shares a bit with the query
and scores the threshold or more, best first, ties by doc_id. With counts of
shared bits c and popcounts p and k the score is c / (p + k - c), so postings
alone give exact scores; fingerprints are never fetched.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.fingerprint import words
from ..runtime import materialize, prepare
from .index import sets_of_bits

#: Distinct fingerprints of a block of a similarity join or a batch search, and queries of one, at most: a task holds two blocks.
JOIN_BLOCK, QUERY_BLOCK = 32768, 8192
#: Tasks of a comparison of blocks, at most; beyond, a task takes several pairs of blocks in turn.
BLOCK_TASKS = 4096
#: Bits that the first look of the similarity join takes.
FIRST_BITS = 128


@dataclass(frozen=True)
class PropertyFilter:
    """A range of a property, both ends included, in 32-bit floats."""

    field: str
    min: float | None = None
    max: float | None = None

    def column(self) -> Column:
        value = F.col(self.field).cast("float")
        out = F.lit(True)
        if self.min is not None:
            out = out & (value >= F.lit(self.min).cast("float"))
        if self.max is not None:
            out = out & (value <= F.lit(self.max).cast("float"))
        return out


@dataclass(frozen=True)
class SimilarityQuery:
    bits: tuple[int, ...]
    threshold: float = 0.7
    top_k: int = 50
    filters: tuple[PropertyFilter, ...] = field(default_factory=tuple)

    def with_filter(self, name: str, low: float | None = None, high: float | None = None) -> SimilarityQuery:
        return SimilarityQuery(self.bits, self.threshold, self.top_k, (*self.filters, PropertyFilter(name, low, high)))

    def with_mw_logp_max(self, mw: float | None = None, logp: float | None = None) -> SimilarityQuery:
        out = self if mw is None else self.with_filter("mw", None, mw)
        return out if logp is None else out.with_filter("logp", None, logp)

    def with_lipinski_filter(self) -> SimilarityQuery:
        return self.with_filter("mw", None, 500).with_filter("logp", None, 5).with_filter("rot_bonds", None, 10)

    @property
    def pop(self) -> int:
        return len(self.bits)

    def validated(self) -> SimilarityQuery:
        """This query; raises ValueError if its threshold is not in [0, 1], nothing is asked for, or it has no bits."""
        if not 0 <= self.threshold <= 1:
            raise ValueError(f"the threshold must be from 0 to 1, not {self.threshold}")
        if self.top_k < 1:
            raise ValueError("top_k must be 1 or more")
        if not self.bits:
            raise ValueError("the query has no bits: is its SMILES readable?")
        return self

    def column(self) -> Column:
        """All property ranges at once; true where there are none."""
        return reduce(Column.__and__, [f.column() for f in self.filters], F.lit(True))


def _scored(counted: DataFrame, p: Column, threshold: Column) -> DataFrame:
    """Rows with c and k that reach the threshold, with their score."""
    score = bits.ratio(F.col("c"), p + F.col("k") - F.col("c"))
    return counted.filter(F.col("c") >= bits.least_shared(threshold, p)).withColumn("score", score).filter(bits.reaches("score", threshold))


def candidates(post: DataFrame, query: SimilarityQuery, band: bool = True) -> DataFrame:
    """doc_id, c (shared bits), k (popcount) of every document that shares a bit with the query and may reach its threshold.

    Bits are literals, so partitions of other bits are pruned; popcounts that
    cannot reach the threshold are cut off in the scan.
    """
    rows = post.filter(F.col("bit").isin(list(query.bits)))
    if band:
        rows = rows.filter(bits.in_band("pop", query.threshold, F.lit(query.pop)))
    return rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("c"), F.max("pop").alias("k"))


def search_all(post: DataFrame, query: SimilarityQuery, props: DataFrame | None = None, band: bool = True, observed: Observation | None = None) -> DataFrame:
    """doc_id, score, c, k of every result, in no order.

    With filters, documents that pass are found first and only their postings
    counted; a document without properties does not pass. ``observed`` gets
    docs_evaluated, the documents whose exact score was needed, as the rows run.
    """
    query.validated()
    if query.filters:
        if props is None:
            raise ValueError("filters need a table with properties")
        post = post.join(props.filter(query.column()).select("doc_id"), "doc_id", "left_semi")
    counted = candidates(post, query, band)
    if observed is not None:
        counted = counted.filter(F.col("c") >= bits.least_shared(query.threshold, F.lit(query.pop))).observe(observed, F.count("*").alias("docs_evaluated"))
    return _scored(counted, F.lit(query.pop), F.lit(query.threshold))


def ranked(rows: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` rows with their rank, from 1; their number is bounded, so ranking them is one small task."""
    best = rows.orderBy(F.desc("score"), "doc_id").limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def search(post: DataFrame, query: SimilarityQuery, props: DataFrame | None = None, band: bool = True, observed: Observation | None = None) -> DataFrame:
    """rank, doc_id, score, c, k of the best results."""
    return ranked(search_all(post, query, props, band, observed), query.top_k).select("rank", "doc_id", "score", "c", "k")


def search_overfetch(post: DataFrame, query: SimilarityQuery, props: DataFrame, times: int = 20) -> DataFrame:
    """The filters applied to the best ``times`` x top_k unfiltered results: may return fewer than there are."""
    plain = SimilarityQuery(query.bits, query.threshold, query.top_k * times)
    kept = search(post, plain).join(props.filter(query.column()).select("doc_id"), "doc_id", "left_semi")
    return ranked(kept.drop("rank"), query.top_k).select("rank", "doc_id", "score", "c", "k")


def scan(fps: DataFrame, query_bits, threshold: float) -> DataFrame:
    """doc_id, score of all documents that reach the threshold, by comparing every fingerprint; at threshold 0 those without a shared bit count too.

    Arrow batches and numpy: as a column expression the 32 counts of words grow
    past what the JVM compiles (measured: 0.1 against 3 million rows a second).
    """
    prepare(fps.sparkSession)
    mine, p = np.array(words(query_bits), np.int64).view(np.uint64), len(set(query_bits))

    def run(batches):
        for batch in batches:
            there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            x = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, bits.WORDS)
            score = np.zeros(len(there), np.float32)
            shared = np.bitwise_count(x & mine).sum(axis=1, dtype=np.int64)
            joint = p + np.bitwise_count(x).sum(axis=1, dtype=np.int64) - shared
            score[there] = np.where(joint > 0, shared / np.maximum(joint, 1), 0)
            at = pa.array(np.flatnonzero(score >= np.float32(threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(score).take(at)], names=["doc_id", "score"])

    return fps.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint").mapInArrow(run, "doc_id long, score float")


def linear(fps: DataFrame, query_bits, threshold: float, top_k: int, sample: int | None = None) -> DataFrame:
    """rank, doc_id, score of the best of a scan."""
    rows = fps.filter(F.col("doc_id") < sample) if sample is not None else fps
    return ranked(scan(rows, query_bits, threshold), top_k).select("rank", "doc_id", "score")


def search_stats(post: DataFrame, query: SimilarityQuery, corpus_size: int) -> DataFrame:
    """One row: docs_evaluated (documents whose exact score was needed), corpus_size, eval_fraction."""
    query.validated()
    needed = candidates(post, query).filter(F.col("c") >= bits.least_shared(query.threshold, F.lit(query.pop)))
    out = needed.agg(F.count("*").alias("docs_evaluated"))
    return out.select("docs_evaluated", F.lit(corpus_size).cast("long").alias("corpus_size"), (F.col("docs_evaluated") / F.lit(float(max(1, corpus_size)))).alias("eval_fraction"))


def _blocks(counts: dict[int, int], most: int) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """Blocks of some ``most`` sets of neighbouring popcounts: first block and number of blocks of each popcount, least and greatest popcount of each block."""
    place, ends, held = {}, [], most
    for p in sorted(counts):
        parts = -(-counts[p] // most)
        if parts > 1:
            place[p] = (len(ends), parts)
            ends += [(p, p)] * parts
            held = most
        elif held + counts[p] > most:
            place[p] = (len(ends), 1)
            ends.append((p, p))
            held = counts[p]
        else:
            place[p] = (len(ends) - 1, 1)
            ends[-1] = (ends[-1][0], p)
            held += counts[p]
    return place, ends


def _per_block(most: int, n: int) -> int:
    """Smaller blocks for fewer sets, so that there is work for many tasks."""
    return min(most, max(1024, -(-n // 16)))


def _counts(sets: DataFrame) -> dict[int, int]:
    return {r.pop: r.n for r in sets.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # 1024 rows at most


def _dealt(sets: DataFrame, place: dict[int, tuple[int, int]], tiles: list[tuple[int, int, int]]) -> DataFrame:
    """``sets`` (with id and pop) once for each tile that their block takes part in: tile and side of each (block, tile, side)."""
    spark = sets.sparkSession
    at = spark.createDataFrame([(p, first, parts) for p, (first, parts) in place.items()], "pop int, first int, parts int")  # 1024 rows at most
    took = spark.createDataFrame(tiles, "block int, tile int, side int")  # two rows for each pair of blocks
    placed = sets.join(F.broadcast(at), "pop").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    return placed.join(F.broadcast(took), "block").drop("block", "first", "parts")


def _by_tile(rows: DataFrame, n_tiles: int) -> DataFrame:
    """Each tile in one task, and tiles one after the other there."""
    n = max(1, min(n_tiles, BLOCK_TASKS))
    return rows.repartitionById(n, (F.col("tile") % n).cast("int")).sortWithinPartitions("tile")


def _tiles(batches):
    """The rows of one tile after the other, in columns by name; the fingerprint as rows of words."""

    def made(held):
        rows = pa.Table.from_batches(held)
        out = {c: rows[c].to_numpy() for c in rows.column_names if c != "fingerprint"}
        return out | {"words": np.concatenate([pc.list_flatten(b.column("fingerprint")).to_numpy(zero_copy_only=False) for b in held]).view(np.uint64).reshape(-1, bits.WORDS)}

    held, now = [], None
    for batch in batches:
        tile = batch.column("tile").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if held and tile[begin] != now:
                yield made(held)
                held = []
            now = tile[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield made(held)


def _unpacked(x: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """Words as rows of 0 and 1 in 32-bit floats, whose products count shared bits exactly."""
    out = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
    return (out if chosen is None else out[:, chosen]).astype(np.float32)


class _Best:
    """The best ``top_k`` documents of each of some queries so far, by score, then id."""

    def __init__(self, top_k: int, p: np.ndarray, threshold: np.ndarray):
        self.top_k, self.p, self.threshold = top_k, p, threshold.astype(np.float32)
        #: What a score must reach to matter, a little below exact; nothing shared never does.
        self.floor = np.maximum(self.threshold * np.float32(1 - 1e-6), np.float32(1e-9))
        self.rows = [np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.float32)]  # query, id, c, k, score

    def add(self, shared: np.ndarray, ids: np.ndarray, k: np.ndarray) -> None:
        score = shared / (self.p.astype(np.float32)[:, None] + k.astype(np.float32)[None, :] - shared)
        mask = score >= self.floor[:, None]
        if len(k) > self.top_k and np.count_nonzero(mask) > 4 * self.top_k * len(self.p):
            best = np.partition(score, len(k) - self.top_k, axis=1)[:, len(k) - self.top_k]
            self.floor = np.maximum(self.floor, best * np.float32(1 - 1e-6))
            mask = score >= self.floor[:, None]
        at = np.flatnonzero(mask)
        if not len(at):
            return
        q, d = np.divmod(at, len(k))
        c = shared.ravel()[at].astype(np.int64)
        exact = (c / (self.p[q] + k[d] - c)).astype(np.float32)
        good = np.flatnonzero(exact >= self.threshold[q])
        rows = [np.concatenate(x) for x in zip(self.rows, (q[good], ids[d[good]], c[good], k[d[good]], exact[good]))]
        order = np.lexsort((rows[1], -rows[4], rows[0]))
        query = rows[0][order]
        first = np.searchsorted(query, np.arange(len(self.p)))
        rank = np.arange(len(query)) - first[query]
        order = order[rank < self.top_k]
        self.rows = [x[order] for x in rows]
        full = np.flatnonzero(rank == self.top_k - 1)
        kept = rows[4][np.lexsort((rows[1], -rows[4], rows[0]))[full]]
        self.floor[query[full]] = np.maximum(self.floor[query[full]], kept * np.float32(1 - 1e-6))


def _search_tiles(top_k: int, evaluated: bool):
    def run(batches):
        """Queries of a tile (side 0) against its documents (side 1): rows of the best of each query; if asked for, a row with the number of candidates, weighted by copies."""
        for rows in _tiles(batches):
            order = np.argsort(rows["pop"], kind="stable")
            rows = {c: x[order] for c, x in rows.items()}
            mine, docs = ({c: x[rows["side"] == k] for c, x in rows.items()} for k in (0, 1))
            for begin in range(0, len(mine["id"]), 1024):
                q = {c: x[begin : begin + 1024] for c, x in mine.items()}
                p, t = q["pop"].astype(np.int64), q["threshold"].astype(np.float32).astype(np.float64)
                x, best = _unpacked(q["words"]), _Best(top_k, p, q["threshold"])
                low, high = np.searchsorted(docs["pop"], [(t * p).min() - 2e-3, ((p + 2e-3) / np.maximum(t, 1e-9)).max()])
                least, most, counted = np.maximum(1, np.ceil(t * p - 1e-4)), (p + 1e-3) / np.maximum(t, 1e-300), np.zeros(len(p))
                for at in range(low, high, 2048):
                    part = slice(at, min(high, at + 2048))
                    shared, k = x @ _unpacked(docs["words"][part]).T, docs["pop"][part].astype(np.int64)
                    best.add(shared, docs["id"][part], k)
                    if evaluated:
                        needed = shared >= least.astype(np.float32)[:, None]
                        if k[-1] > most.min():
                            needed &= k[None, :] <= most[:, None]
                        n = docs["n"][part]
                        counted += needed.sum(axis=1) if n.max() == 1 else needed @ n.astype(np.float64)
                of, ids, c, k, _ = best.rows
                n = np.zeros(len(of), np.int64)
                out = [q["id"][of], ids, c.astype(np.int32), k.astype(np.int32), n]
                names = ["qid", "id", "c", "k", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in out], names=names)
                if evaluated:
                    none = [pa.nulls(len(p), kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(q["id"]), *none, pa.array(counted.astype(np.int64))], names=names)

    return run


def _valid(queries: DataFrame) -> DataFrame:
    """query_id, fingerprint, pop, threshold of the queries that can be answered."""
    fp = F.col("fingerprint") if "fingerprint" in queries.columns else bits.from_bits("bits")
    asked = queries.filter((F.col("threshold") >= 0) & (F.col("threshold") <= 1)).select("query_id", fp.alias("fingerprint"), F.col("threshold").cast("double").alias("threshold"))
    return asked.withColumn("pop", bits.popcount("fingerprint")).filter("pop > 0")


def batch_sets(sets: DataFrame, queries: DataFrame, top_k: int, evaluated: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The best of each query as ``batch`` has them, from rows of doc_id, fingerprint and pop; and, if asked for, query_id, docs_evaluated.

    ``queries``: query_id, threshold, and bits or fingerprint. All queries are
    compared with all documents, exactly, but in blocks: those of neighbouring
    popcounts are together, pairs of blocks whose popcounts cannot reach the
    threshold are passed over, and a task holds one block of each side. What
    leaves it is top_k rows a query. Documents with equal fingerprints are
    compared once, and so are queries.
    """
    spark = prepare(sets.sparkSession)
    sets = materialize(sets.select("doc_id", "fingerprint", "pop"), "sets")
    groups = materialize(sets.groupBy("fingerprint", "pop").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "groups")
    asked = materialize(_valid(queries), "asked")
    distinct = materialize(asked.select("fingerprint", "pop", "threshold").distinct().withColumn("id", F.monotonically_increasing_id()), "queries")
    names = asked.join(distinct, ["fingerprint", "pop", "threshold"]).select("query_id", F.col("id").alias("qid"), F.col("pop").alias("p"), "threshold").distinct()
    names = materialize(names, "names")

    least = distinct.agg(F.min("threshold")).first()[0] or 0.0
    n_docs, n_asked = _counts(groups), _counts(distinct)
    of_doc, docs = _blocks(n_docs, _per_block(JOIN_BLOCK, sum(n_docs.values())))
    of_query, mine = _blocks(n_asked, QUERY_BLOCK)
    pairs = [(i, j) for i, (a, b) in enumerate(mine) for j, (c, d) in enumerate(docs) if d >= least * a - 0.01 and c * least <= b + 0.01]
    left = _dealt(distinct.withColumn("n", F.lit(0).cast("long")), of_query, [(i, k, 0) for k, (i, _) in enumerate(pairs)])
    right = _dealt(groups.withColumn("threshold", F.lit(0.0)), of_doc, [(j, k, 1) for k, (_, j) in enumerate(pairs)])
    rows = left.unionByName(right).select("tile", "side", "id", "n", "pop", "threshold", "fingerprint")
    found = materialize(_by_tile(rows, len(pairs)).mapInArrow(_search_tiles(top_k, evaluated), "qid long, id long, c int, k int, n long"), "found")

    score = bits.ratio(F.col("c"), F.col("p") + F.col("k") - F.col("c"))
    hits = found.filter("id is not null").drop("n").join(names.select("qid", "p").distinct(), "qid").withColumn("score", score)
    # The best documents are among the best groups; of a group, the first top_k are enough.
    hits = _first(hits, Window.partitionBy("qid").orderBy(F.desc("score"), "id"), top_k).drop("rank")
    copies = sets.join(groups.filter("n > 1"), ["fingerprint", "pop"]).filter("doc_id <> id").select("id", "doc_id")
    copies = _first(copies, Window.partitionBy("id").orderBy("doc_id"), top_k).select("id", "doc_id")
    all_hits = hits.withColumn("doc_id", F.col("id")).unionByName(hits.join(copies, "id"))
    best = _first(all_hits, Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"), top_k)
    results = best.join(names.select("qid", "query_id"), "qid").select("query_id", "rank", "doc_id", "score", "c", "k", "p")
    if not evaluated:
        return results, None
    counts = found.filter("id is null").groupBy("qid").agg(F.sum("n").alias("n"))
    return results, names.join(counts, "qid", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("docs_evaluated"))


def _first(rows: DataFrame, order, top_k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def asked_sets(post: DataFrame, queries: DataFrame, props: DataFrame | None = None, condition: Column | None = None) -> DataFrame:
    """doc_id, fingerprint, pop of the documents that share a bit with any of the queries: of the fingerprint, the bits that queries have.

    Bits are literals, 1024 at most, so partitions of other bits are pruned.
    """
    if condition is not None:
        post = post.join(props.filter(condition).select("doc_id"), "doc_id", "left_semi")
    known = [r.bit for r in queries.select(F.explode("bits").alias("bit")).distinct().collect()]
    return sets_of_bits(post.filter(F.col("bit").isin(known)))


def batch(post: DataFrame, queries: DataFrame, top_k: int, props: DataFrame | None = None, condition: Column | None = None) -> DataFrame:
    """query_id, rank, doc_id, score, c, k, p for many queries at once.

    ``queries``: query_id, bits (array of int), threshold. Rows that are not
    valid (no bits, a threshold out of range) give no result; ``report`` names
    them.
    """
    return batch_sets(asked_sets(post, queries, props, condition), queries, top_k)[0]


def _join_tiles(threshold: float):
    t = float(np.float32(threshold))
    share = (1 - t) / (1 + t)

    def batches_of(a, b, score):
        for k in range(0, len(a), 1 << 17):
            x, y = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score[k : k + (1 << 17)])], names=["a", "b", "score"])

    def first_look(x, chosen, left: bool):
        """Columns whose product is what two sets share of the chosen bits, twice, less what they may miss."""
        own = np.bitwise_count(x["words"]).sum(axis=1, dtype=np.int64)
        some = _unpacked(x["words"], chosen)
        rest, ones = (some.sum(axis=1) - share * own).astype(np.float32)[:, None], np.ones((len(own), 1), np.float32)
        return np.hstack([some, -rest, ones]) if left else np.hstack([2 * some, ones, -rest])

    def run(batches):
        """The pairs of a tile that reach the threshold: of two blocks, or within one (side 2)."""
        for rows in _tiles(batches):
            order = np.argsort(rows["pop"], kind="stable")
            rows = {c: x[order] for c, x in rows.items()}
            within = bool((rows["side"] == 2).any())
            x, y = (rows, rows) if within else ({c: v[rows["side"] == k] for c, v in rows.items()} for k in (0, 1))
            if not len(x["id"]) or not len(y["id"]):
                continue
            some = x["words"][:: max(1, len(x["words"]) // 4096)]
            mean = _unpacked(some).mean(axis=0)
            chosen = np.sort(np.argsort(mean * (mean - 1), kind="stable")[:FIRST_BITS])
            right = first_look(y, chosen, False)
            for begin in range(0, len(x["id"]), 1024):
                a = {c: v[begin : begin + 1024] for c, v in x.items()}
                pa_ = a["pop"].astype(np.int64)
                left = first_look(a, chosen, True)
                low, high = np.searchsorted(y["pop"], [t * pa_[0] - 2e-3, (pa_[-1] + 2e-3) / t])
                full = None
                for at in range(max(low, begin) if within else low, high, 4096):
                    part = slice(at, min(high, at + 4096))
                    pb = y["pop"][part].astype(np.int64)
                    hit = left @ right[part].T >= np.float32(-0.05)
                    if within:
                        hit &= np.arange(begin, begin + len(pa_))[:, None] < np.arange(at, part.stop)[None, :]
                    near = np.flatnonzero(hit)
                    if 16 * len(near) > hit.size:  # sets that few bits tell apart: all bits of all of them
                        full = _unpacked(a["words"]) if full is None else full
                        shared = (full @ _unpacked(y["words"][part]).T).ravel()[near].astype(np.int64)
                    else:
                        shared = np.zeros(len(near), np.int64)
                        for k in range(0, len(near), 1 << 16):
                            i, j = np.divmod(near[k : k + (1 << 16)], len(pb))
                            shared[k : k + (1 << 16)] = np.bitwise_count(a["words"][i] & y["words"][part][j]).sum(axis=1, dtype=np.int64)
                    i, j = np.divmod(near, len(pb))
                    score = (shared / (pa_[i] + pb[j] - shared)).astype(np.float32)
                    good = np.flatnonzero(score >= np.float32(threshold))
                    yield from batches_of(a["id"][i[good]], y["id"][part][j[good]], score[good])

    return run


def similarity_join(post: DataFrame, threshold: float) -> DataFrame:
    """a < b, score of documents that score ``threshold`` (above 0) or more. ``post``: doc_id and bit, which may repeat.

    Documents with the same bits are one: the least doc_id stands for them, and
    each other one has a single row with it, of score 1. All other rows are
    pairs of such representatives, so copies cost a row each.

    Representatives are cut into blocks of neighbouring popcounts, and a task
    compares one block with another, or with itself, within the popcounts that
    can reach the threshold. Two sets that reach it differ in few bits, at most
    (1 - t) / (1 + t) of both popcounts: a matrix product over the FIRST_BITS
    bits that vary most in a block rules out nearly all pairs, as differing in
    more of these alone; the words of the others are compared. Only results
    become rows, each once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a similarity join needs a threshold above 0")
    prepare(post.sparkSession)
    sets = materialize(sets_of_bits(post.select("doc_id", "bit")), "sets")
    groups = materialize(sets.groupBy("fingerprint", "pop").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "groups")
    copies = sets.join(groups.filter("n > 1"), ["fingerprint", "pop"]).filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).cast("float").alias("score"))
    counts = _counts(groups)
    place, ends = _blocks(counts, _per_block(JOIN_BLOCK, sum(counts.values())))
    pairs = [(i, j) for i in range(len(ends)) for j in range(i, len(ends)) if ends[j][0] * threshold <= ends[i][1] + 0.01]
    rows = _dealt(groups, place, [x for k, (i, j) in enumerate(pairs) for x in ([(i, k, 2)] if i == j else [(i, k, 0), (j, k, 1)])])
    rows = rows.select("tile", "side", "id", "pop", "fingerprint")
    return _by_tile(rows, len(pairs)).mapInArrow(_join_tiles(threshold), "a long, b long, score float").union(copies)
