"""The different runs of three characters of texts, as ``text.trigrams`` has them, told apart and counted in Arrow batches with numpy (F-05).

Letters are those of Python's Unicode tables, which are newer than Java's.
What a task holds doesn't follow its input: texts are looked at in slices, a long one in pieces, and counts are handed on once ``HELD`` runs are known.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.session import ship

#: Characters (bytes, where texts are dealt out) and texts that are looked at at once.
PIECE, TEXTS = 1 << 19, 512
#: Runs with their counts that a task holds, about.
HELD = 1 << 21
#: Bits of a letter's number in a run's code, of which there are three; the rest of 63 are a language's.
_BITS = 18
_LANGUAGES = 1 << (63 - 3 * _BITS)
_BLANK = ord(" ")


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _plain(text: Column) -> Column:
    """Texts as ``Runs`` takes them: lower-cased, edged by blanks."""
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


class Runs:
    """Codes of runs: letters are numbered as they come, so that keys that are sorted are short; what is no letter is 0."""

    def __init__(self) -> None:
        self.number = np.where(_is_letter(), -1, 0).astype(np.int32)
        self.letters = np.array([_BLANK], np.uint32)

    def _numbers(self, points: np.ndarray) -> np.ndarray:
        out = self.number[points]
        if len(out) and out.min() < 0:
            new = np.unique(points[out < 0])
            self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters = np.concatenate([self.letters, new])
            out = self.number[points]
        return out

    def _distinct(self, texts: Sequence[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``of`` for texts that are looked at at once, the first behind some letters' numbers; also the last two numbers."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        a = np.concatenate([first, self._numbers(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))])
        lengths[0] += len(first)
        begins = np.cumsum(lengths) - lengths
        kept = a != 0
        kept[1:] |= kept[:-1].copy()
        kept[begins] = True
        a, size = a[kept], np.add.reduceat(kept, begins, dtype=np.int64)
        bits = max(1, int(len(self.letters) - 1).bit_length())
        kind = np.uint32 if 3 * bits + (len(texts) - 1).bit_length() <= 32 else np.uint64
        a, width = a.astype(kind), kind(bits)
        doc = np.repeat(np.arange(len(texts), dtype=kind), size)
        key = doc[:-2]
        for k in range(3):
            key = key << width
            key |= a[k : len(a) - 2 + k]
        key = key[doc[:-2] == doc[2:]]
        key.sort()
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        key = key[new]
        mask, code = kind((1 << bits) - 1), np.zeros(len(key), np.int64)
        for k in (2, 1, 0):
            code = code << _BITS | (key >> kind(k * bits) & mask).astype(np.int64)
        return (key >> kind(3 * bits)).astype(np.int64), code, a[-2:].astype(np.int32)

    def of(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which text and which code: each text's different runs. Texts begin and end with a blank."""
        nothing = np.empty(0, np.int32)
        if len(texts) > 1 or not texts or len(texts[0]) <= PIECE:
            return self._distinct(texts, nothing)[:2] if texts else (np.empty(0, np.int64), np.empty(0, np.int64))
        known, last = np.empty(0, np.int64), nothing
        for i in range(0, len(texts[0]), PIECE):
            _, code, last = self._distinct([texts[0][i : i + PIECE]], last)
            known = np.union1d(known, code)
        return np.zeros(len(known), np.int64), known

    def code(self, run: str) -> int | None:
        """A run's code; None for what is none."""
        points = np.array([ord(c) for c in run], np.uint32)
        if len(run) != 3 or any(c != " " and not c.isalpha() for c in run):
            return None
        a, b, c = (int(x) for x in self._numbers(points))
        return a << 2 * _BITS | b << _BITS | c

    def text(self, code: np.ndarray) -> pa.Array:
        """The runs of some codes."""
        points = self.letters[np.stack([code >> k * _BITS & (1 << _BITS) - 1 for k in (2, 1, 0)], axis=1)]
        return pa.array(np.ascontiguousarray(points).view("<U3")[:, 0] if len(code) else [], pa.string())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PIECE bytes in the first column and TEXTS rows at most; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right"))
        j = min(max(i + 1, j), i + TEXTS)
        yield batch.slice(i, j - i)
        i = j


def _summed(keys: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, each once, with their counts' sums."""
    if len(keys) == 1:
        return keys[0], counts[0]
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(n, new)


class _Counts:
    """Cells of each language that have a run."""

    def __init__(self) -> None:
        self.runs, self.languages = Runs(), {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str], languages: pa.Array) -> None:
        coded = languages.dictionary_encode()
        places = np.array([self.languages.setdefault(x, len(self.languages)) for x in coded.dictionary.to_pylist()], np.int64)
        which, code = self.runs.of(texts)
        key = places[coded.indices.to_numpy(zero_copy_only=False)][which] << 3 * _BITS | code
        key, n = np.unique(key, return_counts=True)
        if len(key):
            self.keys.append(key)
            self.counts.append(n)
            self.size += len(key)

    def full(self, languages: pa.Array) -> bool:
        """Whether what is held must be handed on before cells of these languages are counted."""
        if self.size > HELD:
            self.keys, self.counts = map(list, zip(_summed(self.keys, self.counts)))
            self.size = len(self.keys[0])
            if self.size > HELD // 2:
                return True
        return len(self.languages) + sum(x not in self.languages for x in languages.unique().to_pylist()) > _LANGUAGES

    def given(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """What was counted, forgotten afterwards."""
        if self.keys:
            key, n = _summed(self.keys, self.counts)
            names = pa.array(list(self.languages), kind)
            for i in range(0, len(key), 1 << 16):
                k = key[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(k >> 3 * _BITS)), self.runs.text(k & (1 << 3 * _BITS) - 1), pa.array(n[i : i + (1 << 16)])], ["language", "gram", "n"])
        self.languages, self.keys, self.counts, self.size = {}, [], [], 0


def counted(cells: DataFrame, column: str, language: str) -> DataFrame:
    """(language, gram, n): how many cells of a language have a run; a row for each task, or several, that has seen it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = _Counts(), None
        for batch in batches:
            kind = batch.schema.field(1).type
            for part in _slices(batch):
                if held.full(part.column(1)):
                    yield from held.given(kind)
                held.add(part.column(0).to_pylist(), part.column(1))
        yield from held.given(kind)

    ship(cells.sparkSession)
    kind = cells.schema[language].dataType.simpleString()
    return cells.select(_plain(F.col(column)).alias("text"), F.col(language).alias("language")).mapInArrow(run, f"language {kind}, gram string, n bigint")


def nearest(cells: DataFrame, column: str, known: Sequence[Sequence[str]]) -> DataFrame:
    """(at, n): how many cells have more runs of the list at a place than of another, of equals the last; cells without any aren't counted. A row for each task and list."""
    wanted = [list(x) for x in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        pairs = sorted({(code, at) for at, some in enumerate(wanted) for x in some if (code := runs.code(x)) is not None})
        codes, begins, many = np.unique(np.array([c for c, _ in pairs], np.int64), return_index=True, return_counts=True)
        lists, total = np.array([at for _, at in pairs], np.int64), np.zeros(len(wanted), np.int64)
        for batch in batches if len(codes) else ():
            for part in _slices(batch):
                which, code = runs.of(part.column(0).to_pylist())
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                which, at = which[hit], at[hit]
                times = many[at]
                of = lists[np.repeat(begins[at] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                shared = np.bincount(np.repeat(which, times) * len(wanted) + of, minlength=part.num_rows * len(wanted)).reshape(-1, len(wanted))
                best = len(wanted) - 1 - shared[:, ::-1].argmax(axis=1)
                total += np.bincount(best[shared.any(axis=1)], minlength=len(wanted))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["at", "n"])

    ship(cells.sparkSession)
    return cells.select(_plain(F.col(column)).alias("text")).mapInArrow(run, "at int, n bigint")
