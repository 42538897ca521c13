import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fpspark.llm import bpe, bpe_stream, chunks, dac, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a", "Hello, World!", "a  b", " a ", "line\nline\n\nlast\n", "tab\t\tand\r\nreturn", "don't they'll I'VE", "x <|endoftext|> y<|endoftext|><|startoftext|>z",
    "é é ﬁ İstanbul ΑΣ ΣΑΣ ß", "你好 世界 🙂🙂 👨‍👩‍👧", "1234567 1.5e10", "!!!???...", "a b　c d", "\x00\x1c\x7f", "ab" * 3000, "ing" * 2000, "!" * 4000, "word " * 3000, "a" * 5000, "<|endoftext|", "́ x́",
]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", i) for i, t in enumerate(TEXTS)] + [(100, None, "n", 0), (3, TEXTS[3], "n", 3), (None, "null id", "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids long")


def test_transducer_equals_library(word):
    codec = bpe.WordCodec(WORD)
    for t in TEXTS:
        assert codec.encode(t) == word.encode(t, add_special_tokens=False).ids, t[:40]


def test_many_together_equal_one_by_one():
    codec = bpe.WordCodec(WORD)
    pieces = [c for t in TEXTS for c in t.split(" ")]
    counts, ids = codec.encode_chunks(pieces)
    at = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [codec.encode(c) for c in pieces]


def test_stream_holds_back_no_more_than_the_lookahead(word):
    machine = bpe.WordCodec(WORD).machine
    rng = np.random.default_rng(3)
    pieces = ["th", "e", "in", "g", "er", "an", "tion", "s", "haha", "qu", "x"]
    for _ in range(5):
        text = "".join(rng.choice(pieces, 4000))
        out, taken = [], 0
        for part in machine.stream(text.encode()):
            out += part
            taken += 1
        assert taken > 1 and out == word.encode(text, add_special_tokens=False).ids
    assert 0 < machine.lookahead < 2000


def test_small_merge_lists():
    vocab = {c: i for i, c in enumerate(bpe.byte_alphabet())} | {"ab": 256, "abc": 257, "aa": 258, "aaaa": 259}
    machine = bpe.Transducer(vocab, [["a", "b"], ["ab", "c"], ["a", "a"], ["aa", "aa"]])
    assert machine.encode(b"abcab") == [257, 256]
    assert machine.encode(b"a" * 7) == [259, 258, vocab["a"]]
    whole, parts = machine.merge([vocab["a"]] * 1001), [i for p in machine.stream(b"a" * 1001) for i in p]
    assert whole == parts


def test_decoders(word):
    codec = bpe.WordCodec(WORD)
    for t in TEXTS:
        ids = codec.encode(t)
        for step in (1, 3, 1000):
            machine = bpe.SurfaceDecoder(pa.array(codec.surface))
            assert (b"".join(machine.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + machine.close()).decode() == word.decode(ids, skip_special_tokens=False)
    machine = bpe.TextDecoder(codec)
    ids = codec.encode("Größe 🙂 und mehr")
    assert "".join(machine.feed([i]) for i in ids) + machine.close() == "größe 🙂 und mehr"


def expected(word, text):
    ids = word.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_digests(docs, word, monkeypatch, piece):
    """Short texts together, and every text a piece of about seven characters at a time: the same ids."""
    monkeypatch.setattr(bpe_stream, "PIECE", piece)
    rows = bpe_stream.encode_decode_digests(docs, WORD, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(word, texts[r.doc_id])
        assert r.ids == word.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_encode_then_decode(docs, word):
    coded = bpe_stream.encode(docs, WORD)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    for r in bpe_stream.decode(coded, WORD, surface=True).collect():
        assert r.decoded == word.decode(r.ids, skip_special_tokens=False)


def test_pieces_and_what_is_held(monkeypatch):
    monkeypatch.setattr(bpe_stream, "PIECE", 10)
    monkeypatch.setattr(bpe, "HELD", 16)
    codec = bpe.WordCodec(WORD)
    store = chunks.Store(codec.encode_chunks)
    for text in [*TEXTS, "x " * 500 + "y" * 300 + "\n" + "!?" * 200]:
        parts = list(bpe_stream.settled(text, codec, store))
        assert [int(i) for p in parts for i in p] == codec.encode(text)
        assert max(map(len, parts), default=0) <= 16 + 2 * codec.machine.lookahead
    assert list(bpe_stream.pieces("ab cd\nef" + "g" * 30 + " h")) == ["ab cd", "ef" + "g" * 30, "h"]


def test_token_counts(docs):
    library = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_counts.token_counts(docs, BYTE, limit=5).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 5), texts[r.doc_id][:40]


def test_store_forgets_and_stays_right():
    store = chunks.Store(lambda many: (np.full(len(many), 2), np.array([x for c in many for x in (len(c), 7)])), cap=10)
    for k in range(5):
        starts, lengths, ids = store.look_up([f"{'x' * i}{k}" for i in range(8)])
        assert [ids[s] for s in starts] == [i + 1 for i in range(8)] and set(lengths) == {2}
    assert len(store.at) <= 16


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 257], list(range(0, 70000, 7)), [1 << 31, 5, (1 << 32) - 1] * 700])
def test_directly_addressable_codes(ids):
    segment = dac.Segment(dac.pack(np.array(ids, np.uint32)))
    assert segment.n == len(ids) and segment.range(0, len(ids)).tolist() == ids
    rng = np.random.default_rng(1)
    for i in rng.integers(0, max(1, len(ids)), 60) if ids else []:
        assert segment[int(i)] == ids[i]
    for a, b in rng.integers(0, len(ids) + 1, (40, 2)):
        assert segment.range(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)]
    with pytest.raises(IndexError):
        segment[len(ids)]


def test_damaged_segments_are_refused():
    data = dac.pack(np.arange(1000, dtype=np.uint32))
    for bad in (data[:-1], b"x" + data[1:]):
        with pytest.raises((ValueError, IndexError)):
            dac.Segment(bad)


@pytest.mark.parametrize("segment, docs_each", [(1 << 20, 4096), (50, 3)])
def test_token_files(spark, docs, word, monkeypatch, segment, docs_each):
    """Rows that repeat a doc_id with other texts, null ids and copies too: the files are the same twice, and give every token singly."""
    monkeypatch.setattr(dac, "SEGMENT_IDS", segment)
    monkeypatch.setattr(dac, "RANGE_DOCS", docs_each)
    docs = docs.union(spark.createDataFrame([(3, "another text", "", 0), (3, "a third", "", 0), (None, "also without", "", 0), (None, "null id", "", 0), (-5, "minus", "", 0)], docs.schema))
    path = dac.write(docs, WORD)
    rows = sorted(dac.read(spark, path).collect(), key=lambda r: r.start)
    assert sorted(dac.read(spark, dac.write(docs.repartition(3), WORD)).collect(), key=lambda r: r.start) == rows
    encoded = lambda t: [*word.encode(t or "", add_special_tokens=False).ids, 2]
    want = Counter((r.doc_id, len(ids := encoded(r.text)), zlib.crc32(np.array(ids, "<u4").tobytes()), ids[-1]) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.last_id) for r in rows) == want
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    order = [-(1 << 63) if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    if segment > 50:
        ids = encoded(TEXTS[4])
        at = next(r.start for r in rows if r.doc_id == 4)
        assert [dac.token(spark, path, at + k) for k in range(len(ids))] == ids
        with pytest.raises(IndexError):
            dac.token(spark, path, rows[-1].start + rows[-1].n_tokens)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_stream.encode_decode_digests(empty, WORD).count() == 0
    assert token_counts.token_counts(empty, BYTE).count() == 0
    assert dac.read(spark, dac.write(empty, WORD)).count() == 0
