"""BPE as a bounded-lookahead streaming transducer, and its inverse as an incremental state machine.

Encoding. Run the merges of a buffer B in order of rank, once with B alone and
once with B followed by anything. Let D be the rightmost boundary left of which
both runs agree; at first D is the end of B. A rule (u, v) moves D only if one
run merges it across D, so u is the token that ends at D, and D moves left by
|u|. A later (higher-ranked) rule (u2, v2) moves D again only if v2 starts at
the new D, that is if v2 grew from u on its left spine. So D moves left by at
most the largest sum of |u| over chains of rules of rising rank in which each
u lies on the left spine of the next v. That sum is the sufficient lookahead:
tokens that end so far before the end of the buffer never change. It is
computed from the merge list in one pass. A rule of equal parts may act twice
at one rank, so one longest token is added.

A word that is no longer than the lookahead settles at its end alone (its last
byte has tokens of its own), so short words advance many at a time; all others
go through ``stream`` byte by byte.

Decoding. ``TextDecoder`` turns ids into text byte by byte and holds back only
an unfinished UTF-8 character; ``SurfaceDecoder`` writes token strings with
blanks between them, as the library does for a file that names no decoder.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

NONE, NO_RANK = 1 << 60, (1 << 31) - 1
#: Bytes of the longest pre-token that is encoded together with others.
TOGETHER = 32
#: Words of 40 characters at most whose ids a worker remembers.
REMEMBERED = 200_000
#: Ids that a stream gathers before it gives them out.
HELD = 1 << 14


def byte_alphabet() -> list[str]:
    """The printable character for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0x100
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Transducer:
    """Encodes one pre-token at a time, in memory bounded by the merge list."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        chars = byte_alphabet()
        self.middle = [vocab[c] for c in chars]
        self.final = [vocab[c + suffix] for c in chars]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        size = {i: 1 for i in (*self.middle, *self.final)}
        spine: dict[int, int] = {}  # token to the left part it was first made of
        best: dict[int, int] = {}  # left part to the longest chain that ends with it
        longest = 0
        for k, pair in enumerate(merges):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            self.rank[u, v] = k
            self.made.append(w)
            size.setdefault(w, size[u] + size[v])
            spine.setdefault(w, u)
            chain, node = 0, v
            while node is not None:
                chain = max(chain, best.get(node, 0))
                node = spine.get(node)
            best[u] = max(best.get(u, 0), size[u] + chain)
            longest = max(longest, size[w])
        self.lookahead = max(best.values(), default=0) + longest
        self.size = size
        self._arrays(max(size) + 1)

    def _arrays(self, n: int) -> None:
        """The merge list as a hash table in arrays: slots of pair and rank."""
        slots = 1 << max(4, (4 * len(self.rank)).bit_length())
        self._mask, self._n = slots - 1, n
        self._pair, self._rank = np.full(slots, -1, np.int64), np.full(slots, NO_RANK, np.int32)
        for (u, v), k in self.rank.items():
            pair = u * n + v
            at = self._slot(pair)
            while self._pair[at] >= 0:
                at = (at + 1) & self._mask
            self._pair[at], self._rank[at] = pair, k
        self._tokens = np.array(self.made, np.int64)
        self._middle, self._final = np.array(self.middle, np.int64), np.array(self.final, np.int64)

    def _slot(self, pair):
        return (pair * 0x9E3779B1 >> 7) & self._mask

    def ranks(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where there is none."""
        pair = u * self._n + v
        at = self._slot(pair)
        out = np.where(self._pair[at] == pair, self._rank[at], NO_RANK)
        open_ = np.flatnonzero((out == NO_RANK) & (self._pair[at] >= 0))
        while len(open_):
            step = (at[open_] + 1) & self._mask
            at[open_] = step
            hit = self._pair[step] == pair[open_]
            out[open_[hit]] = self._rank[step[hit]]
            open_ = open_[~hit & (self._pair[step] >= 0)]
        return out

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and all ids, of pre-tokens: short ones advance together, a merge of each at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        place, found = [], []
        for low, high in ((1, 8), (9, 16), (17, TOGETHER)):
            rows = np.flatnonzero((sizes >= low) & (sizes <= high))
            for at in range(0, len(rows), 1 << 15):
                part = rows[at : at + (1 << 15)]
                n, ids = self._together([words[i] for i in part.tolist()], sizes[part])
                counts[part] = n
                place.append(np.repeat(part, n))
                found.append(ids)
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            ids = self.encode(words[i])
            counts[i] = len(ids)
            place.append(np.full(len(ids), i))
            found.append(np.array(ids, np.int64))
        if not found:
            return counts, np.zeros(0, np.int64)
        return counts, np.concatenate(found)[np.argsort(np.concatenate(place), kind="stable")]

    def _together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of like lengths, as the rows of a table of tokens with links to the next and the one before."""
        n, width = len(words), int(sizes.max()) + 1
        data = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = column == sizes[row] - 1
        token = np.full((n, width), -1, np.int64)
        token[row, column] = np.where(last, self._final[data], self._middle[data])
        rank = np.full((n, width), NO_RANK, np.int32)
        r, c = row[~last], column[~last]
        rank[r, c] = self.ranks(token[r, c], token[r, c + 1])
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        live = np.arange(n)
        while True:
            at = rank[live].argmin(axis=1)
            best = rank[live, at]
            go = best != NO_RANK
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                break
            gone = after[live, at]
            new = self._tokens[best]
            token[live, at], token[live, gone], rank[live, gone] = new, -1, NO_RANK
            following, prior = after[live, gone], before[live, at]
            after[live, at] = following
            inner = following < sizes[live]
            before[live[inner], following[inner]] = at[inner]
            rank[live, at] = NO_RANK
            x, y, z = live[inner], at[inner], following[inner]
            rank[x, y] = self.ranks(token[x, y], token[x, z])
            inner = prior >= 0
            x, y, z = live[inner], prior[inner], at[inner]
            rank[x, y] = self.ranks(token[x, y], token[x, z])
        there = token >= 0
        return there.sum(axis=1), token[there]

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a sequence of ids: lowest rank first, leftmost first."""
        get, made = self.rank.get, self.made
        ranks = [get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == NONE:
                break
            i = ranks.index(r)
            ids[i : i + 2] = (made[r],)
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def encode(self, word: bytes) -> list[int]:
        """The ids of a pre-token."""
        return [i for part in self.stream(word) for i in part]

    def stream(self, word):
        """Lists of ids, each given out once no later byte can change it. ``word`` may be any iterable of bytes."""
        middle, size, hold, most = self.middle, self.size, self.lookahead, 2 * self.lookahead + 1
        buffer: list[int] = []
        last = None
        for b in word:
            if last is not None:
                buffer.append(middle[last])
            last = b
            if len(buffer) >= most:
                ids, at, n = self.merge(buffer[:]), 0, 0
                while at + size[ids[n]] <= len(buffer) - hold:
                    at += size[ids[n]]
                    n += 1
                yield ids[:n]
                buffer = buffer[at:]
        if last is not None:
            yield self.merge([*buffer, self.final[last]])


class WordCodec:
    """A word-level BPE file: text is composed, lower-cased and cut into words, runs of other characters and single digits."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.suffix = model["end_of_word_suffix"] or ""
        self.machine = Transducer(model["vocab"], model["merges"], self.suffix)
        self.surface = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, i in (model["vocab"] | self.special).items():
            self.surface[i] = token
        self.seen: dict[str, list[int]] = {}

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def encode(self, text: str) -> list[int]:
        """The ids of a text; for texts without blanks this is what each chunk adds on its own."""
        if self.cut and "<" in text and self.cut.search(text):
            return [i for k, part in enumerate(self.cut.split(text)) for i in ((self.special[part],) if k % 2 else self.encode(part))]
        if text.isascii() and text.isalpha():  # one word, nothing to cut or compose
            return self._word(text.lower())
        return [i for w in self.words.findall(self.normal(text)) for i in self._word(w)]

    def stream(self, text: str):
        """Lists of ids of a text without blanks, each given out once no later character can change it; their size is bounded."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield [self.special[part]]
                continue
            held: list[int] = []
            for m in self.words.finditer(self.normal(part)):
                for ids in self.machine.stream(m[0].encode()):
                    held += ids
                    if len(held) >= HELD:
                        yield held
                        held = []
            if held:
                yield held

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and all ids, of many texts without blanks."""
        words: list[bytes] = []
        owner: list[int] = []
        fixed: list[tuple[int, int, list[int]]] = []
        for k, chunk in enumerate(chunks):
            if chunk.isascii() and chunk.isalpha():
                words.append(chunk.lower().encode())
                owner.append(k)
            elif "<" in chunk and self.cut and self.cut.search(chunk):
                fixed.append((k, len(words), self.encode(chunk)))
            else:
                for w in self.words.findall(self.normal(chunk)):
                    words.append(w.encode())
                    owner.append(k)
        each, ids = self.machine.encode_many(words)
        of = np.array(owner, np.int64)
        counts = np.bincount(of, each, len(chunks)).astype(np.int64)
        if fixed:
            by_word = np.concatenate(([0], np.cumsum(each)))
            ids = np.insert(ids, np.repeat([by_word[at] for _, at, _ in fixed], [len(x) for *_, x in fixed]), [i for *_, x in fixed for i in x])
            for k, _, x in fixed:
                counts[k] = len(x)
        return counts, ids

    def _word(self, word: str) -> list[int]:
        ids = self.seen.get(word)
        if ids is None:
            ids = self.machine.encode(word.encode())
            if len(word) <= 40:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = ids
        return ids


class TextDecoder:
    """Ids to text as they come. State: the bytes of an unfinished character, and whether a word just ended."""

    def __init__(self, codec: WordCodec):
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.codec, self.back = codec, back
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.blank = False

    @lru_cache(maxsize=65536)  # noqa: B019  one decoder lives as long as its stream
    def _bytes(self, i: int) -> tuple[bytes, bool]:
        token, suffix = self.codec.surface[i], self.codec.suffix
        if token in self.codec.special:
            return token.encode(), True
        ends = bool(suffix) and token.endswith(suffix)
        return bytes(self.back[c] for c in (token[: -len(suffix)] if ends else token)), ends

    def feed(self, ids) -> str:
        out = []
        for i in ids:
            data, ends = self._bytes(i)
            if self.blank:
                out.append(" ")
            out.append(self.utf8.decode(data))
            self.blank = ends
        return "".join(out)

    def close(self) -> str:
        return self.utf8.decode(b"", True)


class SurfaceDecoder:
    """Ids to strings of a table, in UTF-8, with a blank between any two. State: whether anything was written."""

    def __init__(self, table: pa.Array):
        self.table, self.begun = table, False

    def feed(self, ids) -> bytes:
        if not len(ids):
            return b""
        found = self.table.take(pa.array(np.asarray(ids)))
        one = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)
        out = memoryview(pc.binary_join(one, " ")[0].as_buffer())
        if self.begun:
            return b" " + out
        self.begun = True
        return out

    def close(self) -> bytes:
        return b""
