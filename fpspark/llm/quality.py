"""Quality rules: how far a document's character classes and common words lie from its language.

A language's references are two distributions over all its documents: of
characters over classes, and of words over the common words and the rest. A
document is far if the Jensen-Shannon distance (square root of the divergence
to base 2, so 0 to 1) of either histogram exceeds a limit. Few characters or
words scatter more, so a histogram counts only from a least length on.

Common words are those with at least SHARE of a language's words. Every slice
of the input names words with half that share in it, with their counts there;
a common word's counts add up to half its share or more. A second pass counts
the words of which that is true over all documents: the counts are exact, the
tables bounded, and no other word is shuffled.

Every language with LEAST words has references of its own, whatever else the
input holds. Those of the HELD heaviest are broadcast; all words of the others
are counted in a shuffle, and their references are joined to their documents.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, prepare
from .chunks import expand, slices, strings, text_column

#: Least share of a language's words for a common word, and least words of a language with its own references: a common word is there five times.
SHARE, LEAST = 1 / 400, 2000
#: Languages whose references are broadcast, at most; those of others are joined.
HELD = 200
#: Limits of the distances, and the words and characters from which on they count.
CHAR_LIMIT, WORD_LIMIT, MIN_CHARS, MIN_WORDS = 0.28, 0.46, 200, 50
#: The base rules: fewest words, length of windows, and most per cent of words in repeated windows.
FEWEST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
CLASSES = ("lower", "upper", "letter", "mark", "digit", "space", "line end", "stop", "punctuation", "symbol", "other")
_table: list[np.ndarray] = []
_MIX = np.uint64(0x9E3779B97F4A7C15)


def char_classes() -> np.ndarray:
    """The class of every code point."""
    if not _table:
        out = np.full(0x110000, CLASSES.index("other"), np.uint8)
        kinds = {"Ll": "lower", "Lu": "upper", "L": "letter", "M": "mark", "N": "digit", "Z": "space", "P": "punctuation", "S": "symbol"}
        codes = {k: CLASSES.index(v) for k, v in kinds.items()}
        for i in range(len(out)):
            kind = unicodedata.category(chr(i))
            found = codes.get(kind, codes.get(kind[0]))
            if found is not None:
                out[i] = found
        out[9], out[32] = CLASSES.index("space"), CLASSES.index("space")
        for c in "\n\r\x0b\x0c":
            out[ord(c)] = CLASSES.index("line end")
        for c in ".,;:?'":
            out[ord(c)] = CLASSES.index("stop")
        _table.append(out)
    return _table[0]


@dataclass
class Split:
    """The words of a batch of texts: codes into distinct words, and where each text's words begin."""

    offsets: np.ndarray
    codes: np.ndarray
    words: pa.Array
    chars: np.ndarray  # code points of each word

    @classmethod
    def of(cls, texts: pa.Array) -> Split:
        lists = pc.split_pattern(pc.replace_substring_regex(texts, "[\t-\r]", " "), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(chars > 0)))[np.concatenate(([0], np.cumsum(counts)))]
        return cls(offsets, codes[chars > 0], coded.dictionary, chars[chars > 0])

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[offsets])


def class_counts(texts: pa.Array) -> np.ndarray:
    """Characters of each class in each text."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(strings(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lengths)) * len(CLASSES), lengths)
    return np.bincount(owner + char_classes()[points], minlength=len(lengths) * len(CLASSES)).reshape(-1, len(CLASSES))


def repeated_words(split: Split) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found there twice or more."""
    n, owner = len(split.codes), split.owner()
    if n < WINDOW:
        return np.zeros(len(split.offsets) - 1, np.int64)
    with np.errstate(over="ignore"):
        x = (split.codes.astype(np.uint64) + np.uint64(1)) * _MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        m = n - WINDOW + 1
        h = owner[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(WINDOW):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + x[k : k + m]
    inside = owner[:m] == owner[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + WINDOW, -1)
    return sums(np.cumsum(cover[:-1]) > 0, split.offsets)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(codes):
        return np.zeros(len(counts), np.int64)
    has_word = pc.match_substring_regex(coded.dictionary, r"[^\t-\r ]").to_numpy(zero_copy_only=False)[codes]
    key = owner[has_word] * (len(coded.dictionary) + 1) + codes[has_word]
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(owner[has_word][again], minlength=len(counts))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` to the row of ``q`` beside it; 0 for a row without counts."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((a + b) / 2, 0, 1)), 0.0)


def reference(classes: list, words: list, counts: list, n: int) -> tuple:
    """Char classes, common words and their shares, of a language of ``n`` words."""
    c = np.array(classes, float)
    shares = [x / n for x in counts]
    return c / max(c.sum(), 1), words, np.array([*shares, max(0.0, 1 - sum(shares))])


class References(dict):
    """{lang: (char classes, common words, their shares)} of the HELD heaviest languages.

    ``tail``: the same of all others, as a table of classes, words, counts and
    n (words of the language) by lang, or None; ``tail_chars``: their char classes.
    """

    tail: DataFrame | None = None
    tail_chars: tuple = ()


def references(docs: DataFrame) -> References:
    """Each language's distributions over all documents.

    Languages with less than LEAST words have none of their own.
    """
    prepare(docs.sparkSession)
    docs = docs.select("lang", "text").filter("text is not null and lang is not null")

    def candidates(batches):
        for whole in batches:
            for batch in slices(whole):
                langs = np.array(batch.column(0).to_pylist(), object)
                texts = text_column(batch.column(1))
                for lang in np.unique(langs):
                    own = texts.filter(pa.array(langs == lang))
                    split, kinds = Split.of(own), class_counts(own).sum(axis=0)
                    counts = np.bincount(split.codes, minlength=len(split.words))
                    often = np.flatnonzero((counts >= max(1, SHARE / 2 * len(split.codes))) & pc.not_equal(split.words, "").to_numpy(zero_copy_only=False))
                    words = strings(split.words.take(pa.array(often)))
                    n = 1 + len(CLASSES) + len(words)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(["n"] + ["c"] * len(CLASSES) + ["w"] * len(words)), pa.array(["", *CLASSES, *words]), pa.array([len(split.codes), *kinds.tolist(), *counts[often].tolist()], pa.int64())], names=["lang", "kind", "key", "n"])

    shape = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])
    found = materialize(docs.mapInArrow(candidates, shape).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "references")
    per_lang = found.filter(f"kind = 'n' and n >= {LEAST}")
    sizes = {r.lang: r.n for r in per_lang.orderBy(F.desc("n"), "lang").limit(HELD).collect()}
    langs = sorted(sizes)
    mine = found.filter(F.col("lang").isin(langs))
    kinds = {(r.lang, r.key): r.n for r in mine.filter("kind = 'c'").collect()}
    # Slices in which a common word has less than half its share hold less than half of it: the others name at most 2 / SHARE words.
    least = F.coalesce(*[F.when(F.col("lang") == x, SHARE / 2 * n) for x, n in sizes.items()]) if sizes else F.lit(0.0)
    wanted = sorted({r.key for r in mine.filter((F.col("kind") == "w") & (F.col("n") >= least)).select("key").distinct().collect()})

    def counted(batches):
        values = pa.array(wanted, pa.large_string())
        for whole in batches:
            for batch in slices(whole):
                names = np.array(batch.column(0).to_pylist(), object)
                texts = text_column(batch.column(1))
                for lang in np.unique(names):
                    flat = pc.split_pattern(pc.replace_substring_regex(texts.filter(pa.array(names == lang)), "[\t-\r]", " "), " ").flatten()
                    where = pc.drop_null(pc.index_in(flat, value_set=values)).to_numpy(zero_copy_only=False)
                    counts = np.bincount(where, minlength=len(wanted))
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(["w"] * len(at), pa.string()), values.take(pa.array(at)).cast(pa.string()), pa.array(counts[at], pa.int64())], names=["lang", "kind", "key", "n"])

    words: dict[str, dict[str, int]] = {x: {} for x in langs}
    if wanted:
        exact = docs.filter(F.col("lang").isin(langs)).mapInArrow(counted, shape).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        for r in exact.collect():
            if r.n >= SHARE * sizes[r.lang]:
                words[r.lang][r.key] = r.n
    out = References()
    for lang in langs:
        common = sorted(words[lang], key=lambda w, own=words[lang]: (-own[w], w))
        out[lang] = reference([kinds.get((lang, k), 0) for k in CLASSES], common, [words[lang][w] for w in common], sizes[lang])
    others = per_lang.filter(~F.col("lang").isin(langs)).select("lang", F.col("n").alias("size"))
    if len(sizes) < HELD or others.isEmpty():
        return out

    def all_words(batches):
        for whole in batches:
            for batch in slices(whole):
                names = np.array(batch.column(0).to_pylist(), object)
                texts = text_column(batch.column(1))
                for lang in np.unique(names):
                    split = Split.of(texts.filter(pa.array(names == lang)))
                    counts = np.bincount(split.codes, minlength=len(split.words))
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(["w"] * len(at), pa.string()), split.words.take(pa.array(at)).cast(pa.string()), pa.array(counts[at], pa.int64())], names=["lang", "kind", "key", "n"])

    theirs = docs.join(others, "lang", "left_semi").select("lang", "text").mapInArrow(all_words, shape).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    often = theirs.join(others, "lang").filter(F.col("n") >= SHARE * F.col("size")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("key")))).alias("w"))
    classes = found.filter("kind = 'c'").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("c"))
    tail = others.join(classes, "lang").join(often, "lang", "left").select(
        "lang",
        F.array(*[F.coalesce(F.try_element_at("c", F.lit(k)), F.lit(0)) for k in CLASSES]).alias("classes"),
        F.coalesce(F.col("w.key"), F.array().cast("array<string>")).alias("words"),
        F.coalesce(F.transform("w", lambda x: -x["less"]), F.array().cast("array<bigint>")).alias("counts"),
        F.col("size").alias("n"),
    )
    out.tail = materialize(tail, "references-tail")
    out.tail_chars = tuple(reference(r.classes, [], [], 1)[0] for r in out.tail.select("classes").toLocalIterator())  # 11 numbers for each language
    return out


def measure(docs: DataFrame, refs: References) -> DataFrame:
    """The counts, distances and verdict of every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast((dict(refs), [*(r[0] for r in refs.values()), *refs.tail_chars]))
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")

    def run(batches):
        known, all_chars = sent.value
        for whole in batches:
            for batch in slices(whole):
                texts, n = text_column(batch.column(2)), batch.num_rows
                split, kinds = Split.of(texts), class_counts(texts)
                n_words = np.diff(split.offsets)
                repeats = repeated_words(split)
                langs = np.array(batch.column(1).to_pylist(), object)
                char_js, word_js = np.zeros(n), np.zeros(n)
                alone = np.ones(n, bool)
                for lang in {x for x in langs if x is not None}:
                    rows = langs == lang
                    ref = known.get(lang)
                    if ref is None and batch.num_columns > 3 and (own := batch.slice(int(rows.argmax()), 1).to_pylist()[0])["n"]:
                        ref = reference(own["classes"], own["words"], own["counts"], own["n"])
                    if ref is None:
                        continue
                    alone &= ~rows
                    chars, common, shares = ref
                    values, k = pa.array(common, pa.large_string()), len(common) + 1
                    codes = split.codes[expand(split.offsets[:-1][rows], n_words[rows])]
                    distinct, which = (split.words, codes) if len(codes) > len(split.words) else (lambda u: (split.words.take(pa.array(u[0])), u[1]))(np.unique(codes, return_inverse=True))
                    place = pc.fill_null(pc.index_in(distinct, value_set=values), len(common)).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(rows.sum()), n_words[rows])
                    hist = np.bincount(row * k + place[which], minlength=rows.sum() * k).reshape(-1, k)
                    char_js[rows], word_js[rows] = distance(kinds[rows], chars), distance(hist, shares)
                if alone.any() and all_chars:  # the nearest language counts, and its words do not
                    char_js[alone] = np.min([distance(kinds[alone], chars) for chars in all_chars], axis=0)
                failed = (n_words < FEWEST_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
                far = ((kinds.sum(axis=1) >= MIN_CHARS) & (char_js > CHAR_LIMIT)) | ((n_words >= MIN_WORDS) & (word_js > WORD_LIMIT))
                symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]")
                columns = [n_words, sums(split.chars, split.offsets), symbols.cast(pa.int64()), repeated_lines(texts), repeats, failed, ~failed & ~far, char_js, word_js]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], names=["doc_id", *NAMES])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in NAMES[:5]), *(T.StructField(c, T.BooleanType()) for c in NAMES[5:7]), *(T.StructField(c, T.DoubleType()) for c in NAMES[7:])])
    if refs.tail is None:
        return docs.mapInArrow(run, schema)
    direct = F.col("lang").isNull() | F.col("lang").isin(list(refs))
    return docs.filter(direct).mapInArrow(run, schema).union(docs.filter(~direct).join(refs.tail, "lang", "left").select("doc_id", "lang", "text", "classes", "words", "counts", "n").mapInArrow(run, schema))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, lang, text) against the references of its language.

    A null text counts as empty: no words, so the base rules fail it. A row
    whose language is null or too rare for references of its own is held
    against the nearest language by its characters alone; without any reference
    both distances are 0.
    A distance that ties with its limit passes. Texts of any length are judged
    whole. Rows that repeat, or lack a doc_id, each give a row; other columns
    are not read; an empty table gives an empty table.
    """
    return measure(docs, references(docs))
