"""Texts as columns of space-separated chunks, and a worker's store of what each distinct chunk encodes to.

A batch of texts is split and dictionary-encoded in Arrow, so Python handles
each distinct chunk of a batch once and numpy the rest.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


pa.set_memory_pool(pa.system_memory_pool())  # workers give back what a batch took
#: Bytes of text after which a worker returns what it has freed to the system.
TRIM_AFTER = 64 << 20
_seen = [0]


def trim(n: int) -> None:
    """Count ``n`` bytes of text as worked on; now and then return freed memory to the system, where its C library can."""
    _seen[0] += n
    if _seen[0] >= TRIM_AFTER:
        _seen[0] = 0
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def text_column(column: pa.Array) -> pa.Array:
    """Texts as large strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 6 << 20):
    """The batch in row slices of about ``limit`` bytes of text (a row is never cut)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        trim(int(ends[to - 1] - base))
        at = to


def split(texts: pa.Array, sep: str = " ") -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's chunks, and all chunks in order."""
    lists = pc.split_pattern(texts, sep)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(counts))), flat


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges [start, start + length), in order."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Store:
    """What chunks encode to: at most ``cap`` of them with ``most`` characters and ids are remembered, in one flat array.

    ``asked`` and ``missed`` count the distinct chunks of all look-ups.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cap: int = 400_000, most: int = 12 << 20):
        """encode: the numbers of ids of each of a list of chunks, and all ids."""
        self.encode, self.cap, self.most = encode, cap, most
        self.asked = self.missed = 0
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.starts, self.lengths, self.ids = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def look_up(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each chunk's ids, and the array they are in."""
        found = np.fromiter(map(self.at.get, distinct, [-1] * len(distinct)), np.int64, len(distinct))
        missing = np.flatnonzero(found < 0).tolist()
        if self.at and (len(self.at) + len(missing) > self.cap or self.held > self.most):
            self._clear()
            return self.look_up(distinct)
        self.asked, self.missed = self.asked + len(distinct), self.missed + len(missing)
        if missing:
            new = [distinct[i] for i in missing]
            lengths, ids = self.encode(new)
            self.held += sum(map(len, new)) + len(ids)
            n = len(self.lengths)
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
            found[missing] = np.arange(n, n + len(new))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids.astype(np.uint32)])
        return self.starts[found], self.lengths[found], self.ids


def encode_texts(texts: pa.Array, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's ids, and all ids: texts whose chunks between blanks encode on their own."""
    offsets, flat = split(pc.replace_substring(texts, "\n", " "))
    coded = flat.dictionary_encode()
    starts, lengths, ids = store.look_up(strings(coded.dictionary))
    which = coded.indices.to_numpy(zero_copy_only=False)
    each = lengths[which]
    before = np.concatenate(([0], np.cumsum(each)))
    return before[offsets], ids[expand(starts[which], each)]
