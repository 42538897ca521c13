"""Toxicity: a lexicon trie met by Levenshtein automata, and windows of context that tell quotation from abuse.

The lexicon is learned from labelled documents: words that stand in toxic
documents and almost nowhere else, more often than chance gives; near copies
count as one document. Words are runs of letters, marks and digits, however
they are parted. Every distinct word is run against the trie: the word's Levenshtein automaton (a bit mask of
its states for each number of edits) steps along the edges of the trie and
gives up a branch when no state is left. Short terms must match exactly, longer
terms within one edit.

Languages that inflect have toxic stems rather than words: prefixes, nodes of
the trie, of which toxic documents hold several words and others do not. One
word of a stem says little, so a document's words of stems count together: by
how much likelier their number is at the rate of toxic documents than at that of
clean ones.

A hit counts as quoted when it stands between quotation marks, on a quoted
line, or when a word of report or mention stands near; quoted hits weigh on
their own. A logistic model of the hits, fitted on the same sample, gives the
score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, prepare
from .bagminhash import mix, shingles
from .chunks import slices, split, strings, text_column

#: The bounded sample that is learned from: documents of each label at most, in the order of a hash of their ids.
SAMPLE = {1: 5000, 0: 15_000}
#: Terms at most (a bound of the model, like the sample's: the terms in most toxic documents stay); least share of toxic documents among those with a term; most chance that a harmless word stands in toxic documents only.
MOST_TERMS, PRECISION, CHANCE = 2000, 0.95, 1e-7
#: From which length on a term may be misspelled; words to each side that are a hit's context.
FUZZY_FROM, WINDOW = 5, 8
#: Words of report and mention (fixed values).
MENTIONS = frozenset("said says quote quoted quotes called word term slur wrote reported zitat sagte wort genannt cita dijo palabra citation dit mot".split())
OPEN, CLOSE = "\"“«„‘", "\"”»“’"
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Letters of a stem, words of it that a toxic document holds, and least share of toxic documents among those that hold as many.
STEMS, STEM_WORDS, STEM_PRECISION = range(4, 9), 3, 0.8
#: Chunks that a worker remembers, and characters of the longest that it keeps.
REMEMBERED, LONGEST = 400_000, 64
#: Bands, and hashes in each, of the signatures that tell near copies in the sample.
BANDS, ROWS = 6, 3


def words_in(chunk: str) -> list[str]:
    """The words of a chunk: composed, case-folded, without what stands around and between them."""
    if not chunk.isascii():
        chunk = unicodedata.normalize("NFC", chunk)
    return [w.casefold() for w in WORD.findall(chunk)]


class Trie:
    """Terms as a trie; node: {character: node}, with "" for the term that ends there."""

    def __init__(self, terms):
        self.root: dict = {}
        self.terms = set(terms)
        self.heads: set[tuple[int, str]] = set()
        self.tails: set[tuple[int, str]] = set()
        for t in self.terms:
            if len(t) >= FUZZY_FROM:
                node = self.root
                for c in t:
                    node = node.setdefault(c, {})
                node[""] = t
                # one edit leaves one half of a term whole
                half = len(t) // 2
                for n in (len(t) - 1, len(t), len(t) + 1):
                    self.heads.add((n, t[:half]))
                    self.tails.add((n, t[half:]))
        self.head_sizes = sorted({len(h) for _, h in self.heads})
        self.tail_sizes = sorted({len(h) for _, h in self.tails})

    def near(self, word: str, edits: int = 1) -> str | None:
        """A term within ``edits`` edits of ``word``, the first in order of the alphabet; None if there is none."""
        n = len(word)
        if edits == 1 and not (any((n, word[:k]) in self.heads for k in self.head_sizes) or any((n, word[-k:]) in self.tails for k in self.tail_sizes)):
            return None
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        full, final = (1 << n + 1) - 1, 1 << n
        start, mask = [], 1
        for _ in range(edits + 1):
            start.append(mask)
            mask = (mask | mask << 1) & full
        found, stack = [], [(self.root, start)]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    if any(s & final for s in states):
                        found.append(child)
                    continue
                hit = at.get(c, 0)
                after = [(states[0] & hit) << 1]
                for e in range(1, edits + 1):
                    # match; the term has one character more; another character; the word has one more
                    after.append(((states[e] & hit) << 1 | states[e - 1] | states[e - 1] << 1 | after[e - 1] << 1) & full)
                if any(after):
                    stack.append((child, after))
        return min(found, default=None)


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    clean: list[str] = field(default_factory=list)  # near forms that clean documents of the sample hold
    weights: list[float] = field(default_factory=lambda: [-4.0, 4.0, 2.0, 0.0, 0.0])
    stems: list[str] = field(default_factory=list)
    rates: tuple[float, float] = (0.01, 0.001)  # of words of stems among a toxic document's words, and a clean one's


class Scorer:
    """A worker's trie, and what it remembers of chunks: 0 nothing, 1 a term, 2 nearly a term, 3 a word of a stem."""

    def __init__(self, model: Model):
        self.model, self.trie, self.clean = model, Trie(model.terms), frozenset(model.clean)
        self.stems = tuple(model.stems)
        toxic, clean = model.rates
        self.gain, self.loss = math.log(toxic / clean), toxic - clean
        self.seen: dict[str, int] = {}

    def kind(self, chunk: str) -> int:
        words = words_in(chunk)
        if any(w in self.trie.terms for w in words):
            return 1
        if self.stems and any(w.startswith(self.stems) for w in words):
            return 3
        return 2 if any(self.nearly(w) for w in words) else 0

    def nearly(self, word: str) -> bool:
        """Whether a word is no term but one edit from one, and no word of clean text."""
        return len(word) >= FUZZY_FROM - 1 and word not in self.trie.terms and word not in self.clean and self.trie.near(word) is not None

    def kinds(self, chunks: list[str]) -> np.ndarray:
        seen = self.seen
        out = np.fromiter(map(seen.get, chunks, [-1] * len(chunks)), np.int8, len(chunks))
        missing = np.flatnonzero(out < 0).tolist()
        if len(seen) + len(missing) > REMEMBERED:
            seen.clear()
        for i in missing:
            out[i] = self.kind(chunks[i])
            if len(chunks[i]) <= LONGEST:
                seen[chunks[i]] = int(out[i])
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text, the logarithm of 1 + its terms, near terms, quoted hits, and the weight of its words of stems."""
        out = self.counts(texts)
        return np.log1p(np.column_stack([out[:, :3], np.maximum(out[:, 3] * self.gain - out[:, 4] * self.loss, 0)]))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """For each text its terms, near terms, quoted hits, and distinct chunks with a word of a stem; where it has any of these, its distinct chunks."""
        flat_texts = pc.replace_substring_regex(texts, "[\t-\r]", " ")
        offsets, flat = split(flat_texts)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        kinds = self.kinds(strings(coded.dictionary))[codes]
        out = np.zeros((len(texts), 5))
        for i in np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(kinds > 0)))[offsets])).tolist():
            a, b = int(offsets[i]), int(offsets[i + 1])
            own = np.unique(codes[a:b], return_index=True)[1]
            out[i, 3], out[i, 4] = (kinds[a:b][own] == 3).sum(), len(own)
            hits = np.flatnonzero((kinds[a:b] > 0) & (kinds[a:b] < 3)).tolist()
            if not hits:
                continue
            chunks = strings(flat.slice(a, b - a))
            quoted = self.quoted(chunks, hits)
            for h, q in zip(hits, quoted, strict=True):
                out[i, 2 if q else kinds[a + h] - 1] += 1
        return out

    @staticmethod
    def quoted(chunks: list[str], hits: list[int]) -> list[bool]:
        """Whether each hit is quoted, told from the window around it."""
        out = []
        for h in hits:
            before, after = chunks[max(0, h - WINDOW) : h], chunks[h + 1 : h + 1 + WINDOW]
            opened = any(c[:1] in OPEN and c[:1] for c in [*before, chunks[h]])
            closed = any(c.rstrip(".,;:!?")[-1:] in CLOSE and c.rstrip(".,;:!?")[-1:] for c in [chunks[h], *after])
            out.append(opened and closed or any(w in MENTIONS for c in (*before, *after) for w in words_in(c)))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        w = np.array(self.model.weights)
        return 1 / (1 + np.exp(-(w[0] + self.features(texts) @ w[1:])))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Weights of a ridge logistic regression by Newton's method, constant first; no weight of a hit below zero."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return [float(w[0]), *np.maximum(w[1:], 0).tolist()]


def _sample(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """Text and label of the bounded sample. A doc_id with several labels counts as toxic if one is."""
    label = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    parts = [label.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(SAMPLE[t]) for t in (0, 1)]
    ids = parts[0].union(parts[1])
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")


def copy_keys(texts: pa.Array) -> np.ndarray:
    """For each text the keys of BANDS bands of ROWS minimum hashes over its distinct five-word shingles; 0 for a text without words."""
    owner, h, _ = shingles(texts)
    n, out = len(texts), np.zeros((len(texts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            for row in range(ROWS):
                least = np.full(n, ~np.uint64(0))
                np.minimum.at(least, owner, mix(h + np.uint64(1 + band * ROWS + row)))
                out[:, band] = mix(out[:, band] + least)
    out[np.bincount(owner, minlength=n) == 0] = 0
    return out.view(np.int64)


def copy_groups(rows: list) -> dict:
    """The group of near copies that each doc_id of the sample is in: those that share a band, and so on. ``rows``: doc_id and keys."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for doc_id, keys in rows:
        for band, key in enumerate(keys):
            if key:
                parent[find((band, key))] = find(("doc", doc_id))
    numbers: dict = {}
    return {doc_id: numbers.setdefault(find(("doc", doc_id)), len(numbers)) for doc_id, _ in rows}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Groups of near copies count once, so a copied document adds no terms.
    Without labels of both kinds the model knows no terms and scores all alike.
    Null labels, doc_ids and texts are passed over; of ties for the sample and
    for the terms the lesser hash, and the first in the alphabet, go in.
    """
    spark = prepare(docs.sparkSession)
    sample = materialize(_sample(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0), "sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model()

    def keys(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(copy_keys(text_column(batch.column(1)))), pa.list_(pa.int64()))], names=["doc_id", "keys"])

    kept = T.StructType([sample.schema["doc_id"], T.StructField("keys", T.ArrayType(T.LongType()))])
    # A row of some numbers for each document of the bounded sample.
    groups = copy_groups(sorted((r.doc_id, r.keys) for r in sample.select("doc_id", "text").mapInArrow(keys, kept).collect()))
    parts = spark.createDataFrame(list(groups.items()), T.StructType([sample.schema["doc_id"], T.StructField("part", T.LongType())]))
    sample = sample.join(F.broadcast(parts), "doc_id").withColumn("first_half", F.xxhash64("part") % 2 == 0)

    def words(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                for text, part, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = {w for w in words_in(text) if len(w) >= 3}
                    stems = Counter(w[:n] for w in own for n in STEMS if len(w) >= n)
                    terms = sorted([*own, *(f"^{x}" for x, n in stems.items() if n >= STEM_WORDS)])
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array([toxic] * len(terms), pa.int32())], names=["part", "term", "toxic"])

    shape = T.StructType([T.StructField("part", T.LongType()), T.StructField("term", T.StringType()), T.StructField("toxic", T.IntegerType())])
    counts = sample.select("text", "part", "toxic").mapInArrow(words, shape).distinct().groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    least = math.ceil(math.log(CHANCE) / math.log(sizes[1] / (sizes[0] + sizes[1])))
    stem = F.col("term").startswith("^")
    share = F.when(stem, STEM_PRECISION).otherwise(PRECISION)
    found = counts.filter((F.col("bad") >= least) & (F.col("bad") >= share * (F.col("bad") + F.col("good"))))
    stems: list[str] = []
    for r in found.filter(stem).orderBy(F.desc(F.col("bad") - F.col("good")), F.length("term"), "term").limit(MOST_TERMS).collect():
        x = r.term[1:]
        if not any(x.startswith(y) or y.startswith(x) for y in stems):
            stems.append(x)
    terms = sorted(r.term for r in found.filter(~stem).orderBy(F.desc("bad"), "term").limit(MOST_TERMS).collect())
    model = Model([t for t in terms if not t.startswith(tuple(stems))] if stems else terms, stems=sorted(stems))

    def near(batches):
        scorer = Scorer(model)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = {w for text in batch.column(0).to_pylist() for w in set(words_in(text)) if scorer.nearly(w)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["form"])

    # The weights are fitted on one half of the sample with the near forms of the other: forms of clean text not met before then count too.
    clean = sample.filter("toxic = 0")
    forms = [sorted(r.form for r in clean.filter(half).select("text").mapInArrow(near, "form string").distinct().collect()) for half in ("first_half", "not first_half")]
    model.clean = forms[0]

    def features(counted):
        def run(batches):
            scorer = Scorer(model)
            for whole in batches:
                for batch in slices(whole):
                    texts = text_column(batch.column(0))
                    x = scorer.counts(texts) if counted else scorer.features(texts)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x[:, : 5 if counted else 4].T), batch.column(1)], names=[*"abcde"[: 5 if counted else 4], "toxic"])

        return run

    if stems:
        # Rates among documents with as many words of stems as made them stems, and among clean ones; half a word more, so that none is 0.
        sums = sample.select("text", "toxic").mapInArrow(features(True), "a double, b double, c double, d double, e double, toxic int")
        bad, good = F.expr(f"toxic = 1 and d >= {STEM_WORDS}"), F.expr("toxic = 0 and d > 0")
        total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0.0))
        r = sums.agg(total("d", bad).alias("d1"), total("e", bad).alias("e1"), total("d", good).alias("d0"), total("e", good).alias("e0")).first()
        model.rates = ((r.d1 + 0.5) / (r.e1 + 1000), (r.d0 + 0.5) / (r.e0 + 1000))
        if model.rates[0] <= model.rates[1]:
            model.stems = []
    rows = sample.filter("not first_half").select("text", "toxic").mapInArrow(features(False), "a double, b double, c double, d double, toxic int").collect()
    if len({r.toxic for r in rows}) == 2:
        model.weights = fit_logistic(np.array([[r.a, r.b, r.c, r.d] for r in rows]), np.array([r.toxic for r in rows], float))
    model.clean = sorted({*forms[0], *forms[1]})
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    A null or empty text has no hits and gets the score of clean text; texts of
    any length are scored whole; a score of just 0.5 is predicted 1. A null
    doc_id has held_out null. Rows that repeat each give a row; other columns
    are not read; an empty table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for whole in batches:
            for batch in slices(whole):
                scores = scorer.scores(text_column(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, whole, whose text the model does not reject: null and empty texts stay, rows that repeat go or stay together."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(sent.value)
        for whole in batches:
            for batch in slices(whole):
                yield batch.filter(pa.array(scorer.scores(text_column(batch.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
