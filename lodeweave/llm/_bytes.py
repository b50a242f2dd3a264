"""Tokenising Arrow string columns with numpy: no Python object per word.

Words are maximal runs of bytes of a class, within one text. Every function here works on a
slice of bounded bytes, so that a worker's memory doesn't follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII letters and digits and everything beyond ASCII: the bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[128:] = True
#: Everything but ASCII white space.
DENSE = np.ones(256, bool)
DENSE[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Key of the hashes, and what the state is multiplied by.
_KEY, _PRIME = np.uint64(0x51F2D1A7C3B8E469), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words that are hashed at once, and of a word that numpy hashes: longer ones are hashed one by one.
_AT_ONCE = 1 << 20
_SHORT = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """The words of some texts: bytes, start and length of each word, words before each text."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    before: np.ndarray  # one more than texts

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.before) - 1), np.diff(self.before))

    def hashes(self, limit: int | None = None) -> np.ndarray:
        """A keyed 64-bit hash of each word, or of its first ``limit`` bytes.

        Eight bytes at a time are mixed into the state, whose start is the length, by a step that isn't linear, so that no pattern of
        letters makes words alike; words of more than ``_SHORT`` bytes take xxHash.
        """
        n = self.length if limit is None else np.minimum(self.length, limit)
        out = np.empty(len(n), np.uint64)
        for k in np.flatnonzero(n > _SHORT):
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.start[k] : self.start[k] + n[k]].tobytes(), seed=int(_KEY))
        short = np.flatnonzero(n <= _SHORT)
        ends = np.cumsum(n[short])
        i = 0
        while i < len(short):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _AT_ONCE, "right")))
            some = short[i:j]
            state, left, at = mix(n[some].astype(np.uint64) * _PRIME ^ _KEY), n[some], self.start[some]
            live = np.flatnonzero(left > 0)
            while len(live):
                within = np.arange(8)
                eight = self.data[np.minimum(at[live, None] + within, len(self.data) - 1)]
                eight[within >= left[live, None]] = 0
                state[live] = mix((state[live] ^ np.ascontiguousarray(eight).view(np.uint64)[:, 0]) * _PRIME)
                left, at = left - 8, at + 8
                live = live[left[live] > 0]
            out[some] = state
            i = j
        return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text begins; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, kind: np.ndarray) -> Words:
    """Lower-cased (A-Z) words of each text: maximal runs of bytes that ``kind`` allows."""
    data, at = raw(column)
    data = LOWER[data]
    inside = kind[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = at[:-1][at[:-1] < at[1:]]
    opens[edges] = inside[edges]
    edges = at[1:][at[:-1] < at[1:]] - 1
    closes[edges] = inside[edges]
    start = np.flatnonzero(opens)
    return Words(data, start, np.flatnonzero(closes) + 1 - start, np.searchsorted(start, at))


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (a longer text is a part of its own)."""
    column = batch.column(batch.schema.get_field_index(text))
    _, at = raw(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def spans_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of so many."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
