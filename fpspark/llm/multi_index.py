"""Embedding near-duplicates with an inverted multi-index.

Vectors are cut into halves, and each half has a codebook of its own, so K + K
centroids make a grid of K * K cells. A vector lives in the cell of its nearest
centroids. It also visits other cells by the multi-sequence algorithm: cells
come in the order of the sum of their two squared distances, through a heap of
pairs of ranks, until the sum exceeds the nearest cell's by a margin. The
margin is set for a target recall: sample vectors are turned by the angle of
the threshold in random directions, and the margin is the quantile of what the
cheaper of the two ways between a vector and its neighbour costs.

Vectors of each length have codebooks of their own. Lengths with few vectors,
and those past the heaviest, have a single cell, where all are compared.

Within a cell (of one label and length) visitors and residents are compared
exactly, in double precision. Large cells are cut into blocks, and a task gets
one pair of blocks; of the links it finds it returns counts for each vector and
a spanning forest, never the pairs. A pair that meets in two cells counts in
the smaller.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, prepare
from .components import components
from .scratch import Scratch

#: Vectors of the bounded sample that codebooks and margin are fitted on: so many for each centroid, and this many at least.
PER_CENTROID, SAMPLE = 16, 4096
#: Vectors of the largest label in a cell, on average; centroids of a half at most; the recall that the margin is set for.
PER_CELL, MOST, RECALL = 64, 1024, 0.995
#: Lengths that have codebooks, at most: the heaviest. Others have one cell.
LENGTHS = 32
#: Rows, and bytes, of a block at most.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Rows of a block that are compared at a time.
AT_ONCE = 512


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's algorithm; an empty one stays where it was."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centers).argmin(axis=1)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T, 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, margin: float):
    """Cells (i, j) in the order of d1[i] + d2[j], as long as that exceeds the least sum by ``margin`` at most."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    end = d1[o1[0]] + d2[o2[0]] + margin
    heap, met = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap:
        cost, a, b = heapq.heappop(heap)
        if cost > end:
            return
        yield o1[a], o2[b]
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(o1) and y < len(o2) and (x, y) not in met:
                met.add((x, y))
                heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))


def fit(sample: np.ndarray, k: int, threshold: float, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, float]:
    """Both codebooks and the margin, from a sample of unit vectors."""
    half = sample.shape[1] // 2
    one, two = kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)
    rng = np.random.default_rng(11)
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    other = threshold * sample + math.sqrt(1 - threshold**2) * noise

    def costs(x, y):
        total = np.zeros(len(x))
        for part, book in ((slice(0, half), one), (slice(half, None), two)):
            d = squared(x[:, part], book)
            total += d[np.arange(len(x)), squared(y[:, part], book).argmin(axis=1)] - d.min(axis=1)
        return total

    way = np.minimum(costs(sample, other), costs(other, sample))
    return one, two, float(np.quantile(way, recall, method="higher")) + 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _unit(column: pa.Array) -> np.ndarray:
    return unit(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _visits(column: pa.Array, book: tuple | None) -> list[list[int]]:
    """The cells of each vector, its own first."""
    if book is None:
        return [[0]] * len(column)
    one, two, margin = book
    x = _unit(column)
    half = x.shape[1] // 2
    d1, d2 = squared(x[:, :half], one), squared(x[:, half:], two)
    return [[i * len(two) + j for i, j in multi_sequence(a, b, margin)] for a, b in zip(d1, d2, strict=True)]


def _cells(reps: DataFrame, books) -> DataFrame:
    """For each vector a row per cell that it lives in or visits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(4).to_numpy(zero_copy_only=False)
            visits: list = [None] * batch.num_rows
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                for i, v in zip(at.tolist(), _visits(batch.column(3).take(pa.array(at)), books.value.get(d)), strict=True):
                    visits[i] = v
            row = np.repeat(np.arange(len(visits)), [len(v) for v in visits])
            cell = np.array([c for v in visits for c in v], np.int64)
            home = np.array([v[0] for v in visits], np.int64)
            resident = cell == home[row]
            mine = pa.array([visits[i] if r else [] for i, r in zip(row.tolist(), resident.tolist(), strict=True)], pa.list_(pa.int64()))
            at = pa.array(row)
            label, node, copies, embedding, d = (batch.column(k).take(at) for k in range(5))
            yield pa.RecordBatch.from_arrays([label, d, pa.array(cell), pa.array(home[row]), mine, node, copies, embedding], names=["label", "d", "cell", "home", "visits", "node", "copies", "embedding"])

    long = T.LongType()
    fields = [reps.schema["label"], T.StructField("d", T.IntegerType()), *(T.StructField(c, long) for c in ("cell", "home")), T.StructField("visits", T.ArrayType(long)), T.StructField("node", long), T.StructField("copies", long), reps.schema["embedding"]]
    return reps.select("label", "node", "copies", "embedding", "d").mapInArrow(run, T.StructType(fields))


def _linker(threshold: float):
    def link(rows: pa.Table) -> pa.Table:
        """The links between two blocks of a cell, or within one: for each vector its linked copies and its least partner in the forest."""
        rows = rows.combine_chunks()
        x = _unit(rows["embedding"].combine_chunks())
        node, copies, home, cell = (rows[c].to_numpy() for c in ("node", "copies", "home", "cell"))
        block, low, high = rows["block"].to_numpy(), rows["low"][0].as_py(), rows["high"][0].as_py()
        resident = home == cell
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        linked = np.zeros((len(left), len(right)), bool)
        for a in range(0, len(left), AT_ONCE):
            part = left[a : a + AT_ONCE]
            linked[a : a + AT_ONCE] = x[part] @ x[right].T >= threshold
        if right is left:
            np.fill_diagonal(linked, False)
        linked &= resident[left][:, None] | resident[right][None, :]
        # a visitor and a resident that also visits the visitor's home meet twice: the smaller cell counts
        visits = rows["visits"]
        for own, other, flip in ((left, right, False), (right, left, True)):
            for a in np.flatnonzero(~resident[own] & (home[own] < cell[own])).tolist():
                view = linked[:, a] if flip else linked[a]
                h = int(home[own[a]])
                for b in np.flatnonzero(view).tolist():
                    if h in visits[int(other[b])].as_py():
                        view[b] = False
                        if right is left:
                            linked[b, a] = linked[a, b] = False
        n = np.zeros(len(node), np.int64)
        least = np.argsort(np.argsort(node, kind="stable")).astype(np.int32)
        for a in range(0, len(left), AT_ONCE):
            part, view = left[a : a + AT_ONCE], linked[a : a + AT_ONCE]
            n[part] += view @ copies[right]
            if right is not left:
                n[right] += view.T @ copies[part]
        far = np.int32(len(node) + 1)
        while linked.size:
            before = least.copy()
            for a in range(0, len(left), AT_ONCE):
                part, view = left[a : a + AT_ONCE], linked[a : a + AT_ONCE]
                least[part] = np.minimum(least[part], np.where(view, least[right][None, :], far).min(axis=1, initial=far))
                least[right] = np.minimum(least[right], np.where(view, least[part][:, None], far).min(axis=0, initial=far))
            if (before == least).all():
                break
        use = n > 0
        return pa.table({"node": node[use], "n": n[use], "partner": np.sort(node)[least[use]]})

    return link


def _books(reps: DataFrame, threshold: float, recall: float) -> dict[int, tuple]:
    """Codebooks and margin for each length that needs more than one cell, from bounded samples."""
    largest = reps.groupBy("label", "d").count().groupBy("d").agg(F.max("count").alias("n"))
    out = {}
    for d, n in largest.filter("d > 1").orderBy(F.desc("n"), "d").limit(LENGTHS).collect():
        k = max(1, min(MOST, round(math.sqrt(n / PER_CELL))))
        if k > 1:
            sample = reps.filter(F.col("d") == d).orderBy(F.xxhash64("embedding"), "node").select("embedding").limit(max(SAMPLE, PER_CENTROID * k)).collect()
            out[d] = fit(unit(np.array([r.embedding for r in sample], np.float64)), k, threshold, recall)
    return out


def near_vectors(table: DataFrame, threshold: float = 0.98, recall: float = RECALL) -> DataFrame:
    """Links between vectors of equal labels and lengths with a cosine of ``threshold`` or more.

    ``table``: vec_id, embedding, label. Returns a row for every row of it:
    vec_id, n_links (other vectors linked directly), component_id (least vec_id
    that links reach, itself included), kept (vec_id = component_id). A vector
    that is null, empty, zero or holds nulls or values that are not finite, one
    without a label, and one without a vec_id link with nothing. A cosine that
    ties with the threshold links. Rows that agree in vec_id, label and vector
    are one vector; other rows of one vec_id are vectors of their own, and do
    not join the labels they stand under. Equal vectors of a label are one
    while links are sought, and count as many. Vectors of any length are taken
    whole; other columns are not read; an empty table gives an empty table.
    """
    spark = prepare(table.sparkSession)
    scratch = Scratch(spark)
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # Of a single component only the sign counts; 0.0 and -0.0 are equal.
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.abs(v)).otherwise(v))
    plain = F.when(F.size("embedding") == 1, F.transform("embedding", lambda v: F.signum(v).cast(table.schema["embedding"].dataType.elementType))).otherwise(plain)
    good = table.filter(valid).select("vec_id", "label", plain.alias("embedding"))
    # Rows that repeat count once; then one node for each vector of a label.
    ids = good.groupBy("label", "embedding", "vec_id").agg(F.lit(1).alias("one"))
    reps = ids.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = materialize(reps.select("label", "embedding", "rep", "copies", F.size("embedding").alias("d"), F.monotonically_increasing_id().alias("node")), "vectors")
    books = spark.sparkContext.broadcast(_books(reps, threshold, recall))
    cells = scratch.keep(_cells(reps, books), "cells")
    crowd = cells.groupBy("label", "d", "cell").agg(F.count("*").alias("n"), F.count_if(F.col("home") == F.col("cell")).alias("residents")).filter("n > 1 and residents > 0")
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("d")))))
    placed = cells.join(crowd, ["label", "d", "cell"]).withColumn("blocks", F.ceil(F.col("n") / rows).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    tiles = tiles.select("label", "d", "cell", "low", "high", "block", "home", "visits", "node", "copies", "embedding")
    found = scratch.keep(tiles.groupBy("label", "d", "cell", "low", "high").applyInArrow(_linker(threshold), "node long, n long, partner long"), "links")
    links = materialize(found.groupBy("node").agg(F.sum("n").alias("n")), "counts")
    classes = components(found.select(F.col("node").alias("a"), F.col("partner").alias("b"))).select(F.col("id").alias("node"), "component")
    least = classes.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reps.join(links, "node", "left").join(classes.join(least, "component").select("node", "component_id"), "node", "left")
    named = named.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    nothing = (F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    scratch.drop()
    return out.union(table.filter(~valid).select("vec_id", *nothing))
