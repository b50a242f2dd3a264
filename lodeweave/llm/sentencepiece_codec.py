"""SentencePiece encoding and decoding by a streaming Viterbi search.

``search`` reads a text once from left to right. For each position the best last piece is kept, as a pointer
back to where it begins; only the last ``longest piece`` positions can still be continued. Positions before
that window which nothing continues are cut off, and as soon as the pointers of all that survive lead back
to one boundary, the ids before it are committed and forgotten.

What "best" means depends on the model's kind. A unigram model takes the path with the largest sum
of scores. In a BPE model the path is the one whose neighbouring pieces are all compatible, that is,
their joint text would be merged into just these two; every prefix has exactly one such path, and it is
what merging by score gives (so ids equal the SentencePiece library's, which plain score sums wouldn't).
Characters without a piece become their bytes, or the unknown id.

Where no piece crosses the border before a blank, all paths meet there whatever stands around it: a text's
stretches between such borders are searched on their own, equal ones of a slice of texts once. Stretches and their borders
are found with numpy; a bounded cache keeps lately searched ones. Stretches within the window are searched in step (``Windows``),
those that are longer or have a character without a piece one by one.

Models are read from a .model file (its path is a parameter), parsed here; they are never trained.
Only the identity normaliser is taken; any other raises ValueError.

Cases: null and empty texts have no ids; ids out of range raise IndexError; a literal U+2581 in a text
decodes to a blank, as in the library; bytes that aren't UTF-8 decode to U+FFFD; rows are independent of
each other, so ties and repeated rows are of no concern; extra columns stay, but one named like the
new one is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.llm import _bytes
from lodeweave.llm._store import arrow

try:
    import ahocorasick
except ImportError:  # then pieces are looked up one by one
    ahocorasick = None

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
#: Entries of a worker's caches at most: stretches (about 220 bytes each) and pairs of pieces (about 120).
_CACHE = 100_000
_PAIRS = 300_000
#: Cells of an automaton's table at most, and slots for pairs of pieces (2 to this power, 8 bytes each).
_CELLS = 1 << 24
_ASKED_BITS = 20
#: Stretches that are searched in step.
_TOGETHER = 1 << 15
#: Bytes of text that are encoded at once.
_SLICE = 1 << 19
_UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[i : i + size]
        i += size


@dataclass
class Model:
    """A SentencePiece model: pieces by id with score and type, and what matters of its settings."""

    pieces: list[tuple[str, float, int]]
    kind: int = BPE
    dummy_prefix: bool = True
    ids: dict[str, int] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (_NORMAL, _USER)}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == _UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == _BYTE}
        self.worst = min((p[1] for p in self.pieces if p[2] == _NORMAL), default=0.0) - _UNKNOWN_PENALTY
        #: Whether stretches between borders before blanks can be searched on their own.
        self.cut = bool(self.bytes) and BLANK in self.ids and not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        #: ASCII white space that is within no piece: a border on both sides.
        self.alone = [ord(c) for c in "\t\n\r\x0b\x0c" if not any(c in p for p in self.ids)]
        order = {x: i for i, x in enumerate(sorted({p[1] for p in self.pieces}, reverse=True))}
        self.rank = {p: order[self.pieces[i][1]] for p, i in self.ids.items()}
        self.automaton = None
        if ahocorasick is not None and self.ids:
            self.automaton = ahocorasick.Automaton()
            for piece, i in self.ids.items():
                self.automaton.add_word(piece, (len(piece), i))
            self.automaton.make_automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def merged(self, text: str) -> list[int]:
        """Ids by merging neighbours, the best score first and the leftmost of equals; of a short text."""
        return [self.ids.get(p, -1) for p in self._merge(text)[0]]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging leaves, and the last two parts that were joined."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joint text of two pieces would be merged into just these two."""
        if left < 0 or right < 0:
            return True
        key = left << 32 | right
        fits = self.fits.get(key)
        if fits is None:
            if len(self.fits) > _PAIRS:
                self.fits.clear()
            fits = self.fits[key] = self._apart(self.pieces[left][0], self.pieces[right][0])
        return fits

    def _apart(self, a: str, b: str) -> bool:
        """Goes back in time from both pieces: at no moment may what touches at the border have been merged.

        A symbol exists from the rank of the merge that made it until the next one; the border's own merge comes
        first if its rank is lower, or equal and further to the left. Runs of blanks, whose ranks are equal, are
        merged for a check instead.
        """
        if not a.strip(BLANK) or not b.strip(BLANK):
            return self._merge(a + b)[0] == [a, b]
        until = len(self.pieces)
        while True:
            met = self.rank.get(a + b)
            if met is not None and met < until:
                return False
            made_a = self.rank[a] if len(a) > 1 else -1
            made_b = self.rank[b] if len(b) > 1 else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until, a = made_a, self._halves(a)[1]
            else:
                until, b = made_b + 1, self._halves(b)[0]

    def _halves(self, piece: str) -> tuple[str, str]:
        if piece not in self.halves:
            self.halves[piece] = self._merge(piece)[1]
        return self.halves[piece]

    def own(self, piece: int) -> bool:
        """Whether merging gives the piece for its own text."""
        if piece not in self.whole:
            self.whole[piece] = self.merged(self.pieces[piece][0]) == [piece]
        return self.whole[piece]


def parsed(data: bytes) -> tuple[list[tuple[str, float, int]], int, bool]:
    """Pieces, kind and whether a blank is put before texts, of a .model file's bytes."""
    pieces, kind, dummy = [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, _NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            f = dict(_fields(value))
            if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                raise ValueError("only the identity normaliser is taken")
            dummy = bool(f.get(3, 1))
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are taken")
    return pieces, kind, dummy


def load(data: bytes) -> Model:
    """The model of a .model file's bytes."""
    return Model(*parsed(data))


def _ends(model: Model, text: str) -> Iterator[list[tuple[int, int]]]:
    """For each position after the first, (begin, id) of the pieces that end there, the longest first; -1: no piece."""
    at, found = 1, []
    if model.automaton is not None:
        for last, (size, i) in model.automaton.iter(text):
            while at <= last:
                yield found if found and found[-1][0] == at - 1 else [*found, (at - 1, -1)]
                at, found = at + 1, []
            found.append((last + 1 - size, i))
    else:
        for at in range(1, len(text) + 1):
            found = [(b, model.ids[text[b:at]]) for b in range(max(0, at - model.longest), at) if text[b:at] in model.ids]
            if at < len(text):
                yield found if found and found[-1][0] == at - 1 else [*found, (at - 1, -1)]
    for at in range(at, len(text) + 1):
        yield found if found and found[-1][0] == at - 1 else [*found, (at - 1, -1)]
        found = []


def search(model: Model, text: str) -> Iterator[tuple[int, str]]:
    """(id or -1, its text) of each piece, committed as soon as all surviving paths agree on it."""
    reach, pieces, bpe = model.longest, model.pieces, model.kind == BPE
    back: dict[int, tuple[int, int]] = {}  # end -> (begin, id) of what isn't committed
    kids = {0: [0, 0]}  # position -> number of the surviving positions that lead back to it, and their sum
    total = {0: 0.0}
    root = 0
    for end, fits in enumerate(_ends(model, text), 1):
        best = None
        if bpe:
            for begin, found in fits:
                if (end - begin == 1 or model.own(found)) and (begin == 0 or model.compatible(back[begin][1] if begin in back else last, found)):
                    break
        else:
            for at, piece in fits:
                score = total[at] + (pieces[piece][1] if piece >= 0 else model.worst)
                if best is None or score > best:
                    best, begin, found = score, at, piece
            total[end] = best
            total.pop(end - reach, None)
        back[end] = (begin, found)
        kids[end] = [0, 0]
        kids[begin][0] += 1
        kids[begin][1] += end
        gone = end - reach  # nothing that is still to come begins here or before
        at = gone
        while at > root and at in kids and not kids[at][0]:
            before = back.pop(at)[0]
            del kids[at]
            kids[before][0] -= 1
            kids[before][1] -= at
            at = before
        while root <= gone and kids[root][0] == 1:
            to = kids.pop(root)[1]
            last = back.pop(to)[1]
            yield last, text[root:to]
            root = to
    path = []
    end = len(text)
    while end > root:
        begin, found = back[end]
        path.append((found, text[begin:end]))
        end = begin
    yield from reversed(path)


def search_window(model: Model, text: str) -> list[int]:
    """Ids (-1: a character without a piece) of a text no longer than the window, of a BPE model: as ``search``, but nothing can be committed before its end."""
    n = len(text)
    ids, begins = [-1] * (n + 1), [-1] * (n + 1)
    fits, whole, upto = model.fits, model.whole, 0
    for last, (size, found) in model.automaton.iter(text):
        end = last + 1
        if begins[end] >= 0:  # a longer piece holds here already
            continue
        while upto < last:
            upto += 1
            if begins[upto] < 0:
                begins[upto] = upto - 1
        begin = end - size
        if size > 1:
            own = whole.get(found)
            if not (model.own(found) if own is None else own):
                continue
        left = ids[begin]
        if begin and left >= 0:
            fit = fits.get(left << 32 | found)
            if not (model.compatible(left, found) if fit is None else fit):
                continue
        ids[end], begins[end] = found, begin
    while upto < n:
        upto += 1
        if begins[upto] < 0:
            begins[upto] = upto - 1
    out = []
    while n:
        out.append(ids[n])
        n = begins[n]
    out.reverse()
    return out


class Windows:
    """``search_window`` for many texts at once, in numpy: all are read in step, a character at a time.

    An automaton of the pieces gives the longest piece that ends at a character, and each piece the next shorter one that it ends
    with; of these the first that its neighbour is compatible with is the best last piece there.
    """

    def __init__(self, model: Model):
        self.model = model
        heads, kinds = self._parts(model)
        states = {x: i for i, x in enumerate(["", *itertools.chain(*heads)])}
        going = {x[:-1] for x in itertools.chain(*heads)}
        #: Of each character its kind (0: in no longer piece) and the piece that it is.
        self.kind = np.zeros(max([0, *map(ord, kinds), *(ord(p) for p in model.ids if len(p) == 1)]) + 2, np.int32)
        self.single = np.full(len(self.kind), -1, np.int32)
        self.kind[[ord(c) for c in kinds]] = list(kinds.values())
        for piece, i in model.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        #: The state after a state's row and a kind; states that nothing continues have the row of what they end with.
        self.next = np.zeros((len(going) or 1, len(kinds) + 1), np.uint16 if len(states) <= 1 << 16 else np.int32)
        self.row, self.longest, back = np.zeros(len(states), np.int32), np.full(len(states), -1, np.int32), np.zeros(len(states), np.int32)
        self.size = np.array([len(p) for p, _, _ in model.pieces], np.int32)
        self.shorter = np.full(len(model.pieces), -1, np.int32)
        rows = 1
        for k, (here, longer) in enumerate(zip([[""], *heads], [*heads, []])):
            for x in here if k else ():
                state, before = states[x], states[x[:-1]]
                end = back[state] = self.next[self.row[back[before]], kinds[x[-1]]] if k > 1 else 0
                self.row[state], self.longest[state] = self.row[end], self.longest[end] if end else self.single[ord(x[-1])]
                if x in going:
                    self.next[rows] = self.next[self.row[end]]
                    self.row[state] = rows
                    rows += 1
                found = model.ids.get(x, -1) if k > 1 else -1
                if found >= 0 and model.own(found):
                    self.shorter[found], self.longest[state] = self.longest[state], found
            for x in longer:
                self.next[self.row[states[x[:-1]]], kinds[x[-1]]] = states[x]
        #: Pairs asked for lately, twice their number plus whether they fit, each where its hash puts it.
        self.asked = np.full(1 << _ASKED_BITS, -1, np.int64)

    @staticmethod
    def _parts(model: Model) -> tuple[list[list[str]], dict[str, int]]:
        """What pieces of two characters or more begin with, by length, and the kinds of their characters."""
        long = [p for p in model.ids if len(p) > 1]
        begun = {p[:k] for p in long for k in range(1, len(p) + 1)}
        return [sorted(x for x in begun if len(x) == k) for k in range(1, model.longest + 1)], {c: k for k, c in enumerate(sorted({c for p in long for c in p}), 1)}

    @classmethod
    def fit(cls, model: Model) -> bool:
        """Whether the automaton's table of this model is of a size to be held."""
        if model.kind != BPE:
            return False
        heads, kinds = cls._parts(model)
        return len({x[:-1] for x in itertools.chain(*heads)}) * (len(kinds) + 1) <= _CELLS

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Model.compatible`` of each pair of pieces."""
        pair = left.astype(np.int64) * len(self.size) + right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _ASKED_BITS)).astype(np.int64)
        got = self.asked[slot]
        lost = np.flatnonzero(got >> 1 != pair)
        if len(lost):
            new, first, which = np.unique(pair[lost], return_index=True, return_inverse=True)
            firsts = lost[first]
            fits = np.array([self.model.compatible(a, b) for a, b in zip(left[firsts].tolist(), right[firsts].tolist())], np.int64)
            self.asked[slot[firsts]] = made = new * 2 + fits
            got[lost] = made[which]
        return (got & 1).astype(bool)

    def search(self, texts: list[bytes]) -> list[bytes | None]:
        """The ids of each text, not empty and no longer than the window, as bytes of 32-bit numbers; None: a character has no piece."""
        if not texts:
            return []
        raw = b"".join(texts)
        begins_char = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        ends = np.cumsum(begins_char)[np.cumsum([len(x) for x in texts]) - 1]
        n = np.diff(ends, prepend=0)
        code = np.frombuffer(raw.decode().replace(" ", BLANK).encode("utf-32-le"), np.uint32)
        code = np.minimum(code, len(self.kind) - 1)
        order = np.argsort(-n, kind="stable")  # the longest first, so that those not yet read to their end are the first ones
        at, n = (ends - n)[order], n[order]
        most, every = int(n[0]), np.arange(len(n))
        ids, begins = np.full((most + 1, len(n)), -1, np.int32), np.zeros((most + 1, len(n)), np.int32)
        state = np.zeros(len(n), np.int32)
        for end in range(1, most + 1):
            live = int(np.searchsorted(-n, -end, "right"))
            read = code[at[:live] + end - 1]
            state[:live] = self.next[self.row[state[:live]], self.kind[read]]
            begins[end, :live] = end - 1
            todo, piece = every[:live], np.where(state[:live] > 0, self.longest[state[:live]], self.single[read])
            while True:
                some = piece >= 0
                todo, piece = todo[some], piece[some]
                if not len(todo):
                    break
                begin = end - self.size[piece]
                left = ids[begin, todo]
                fits = left < 0
                ask = np.flatnonzero(~fits)
                fits[ask] = self.compatible(left[ask], piece[ask])
                ids[end, todo[fits]], begins[end, todo[fits]] = piece[fits], begin[fits]
                todo, piece = todo[~fits], self.shorter[piece[~fits]]
        out, count, whole = np.zeros((len(n), most), np.int32), np.zeros(len(n), np.int64), np.ones(len(n), bool)
        end, going = n.copy(), every
        while len(going):
            count[going] += 1
            found = ids[end[going], going]
            out[going, most - count[going]] = found
            whole[going[found < 0]] = False
            end[going] = begins[end[going], going]
            going = going[end[going] > 0]
        flat, upto = out.tobytes(), (every + 1) * most * 4
        made: list[bytes | None] = [None] * len(n)
        for i, a, b, good in zip(order.tolist(), (upto - 4 * count).tolist(), upto.tolist(), whole.tolist()):
            if good:
                made[i] = flat[a:b]
        return made


_encoders: dict[bytes, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """This process's encoder of a model: workers are used again, and so is what they have found."""
    if data not in _encoders:
        _encoders.clear()
        _encoders[data] = Encoder(load(data))
    return _encoders[data]


class Encoder:
    """Ids of texts, with a bounded cache of stretches."""

    def __init__(self, model: Model):
        self.model = model
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @functools.cached_property
    def windows(self) -> Windows | None:
        return Windows(self.model) if Windows.fit(self.model) else None

    def searched(self, text: str) -> bytes:
        """The ids of a text whose blanks are U+2581, as bytes of 32-bit numbers."""
        m, out = self.model, []
        if m.automaton is not None and m.kind == BPE and len(text) <= m.longest:
            out = search_window(m, text)
            if -1 not in out:
                return array("i", out).tobytes()
            out = []
        unknown = False
        for found, piece in search(m, text):
            if found >= 0:
                out.append(found)
            elif m.bytes:
                out += [m.bytes[b] for b in piece.encode()]
            elif not unknown:
                out.append(m.unknown)
            unknown = found < 0 and not m.bytes
        return array("i", out).tobytes()

    def found(self, keys: list[bytes]) -> list[bytes]:
        """The ids of distinct stretches: from the cache, of which the half that wasn't used lately goes when it is full, or searched together."""
        got = [self.new.get(key) for key in keys]
        lost = [i for i, x in enumerate(got) if x is None]
        for i in lost:
            got[i] = self.old.get(keys[i])
        if self.windows is not None:
            longest = self.model.longest
            short = [i for i in lost if got[i] is None and (len(keys[i]) <= longest or len(keys[i]) <= 4 * longest and len(keys[i].decode()) <= longest)]
            for a in range(0, len(short), _TOGETHER):
                some = short[a : a + _TOGETHER]
                for i, x in zip(some, self.windows.search([keys[i] for i in some])):
                    got[i] = x
        for i in lost:
            if got[i] is None:
                got[i] = self.searched(keys[i].decode().replace(" ", BLANK))
            if len(keys[i]) <= 64:
                if len(self.new) > _CACHE // 2:
                    self.old, self.new = self.new, {}
                self.new[keys[i]] = got[i]
        return got

    def batch(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        data, at = _bytes.raw(column)
        full = np.diff(at) > 0
        if self.model.dummy_prefix:
            data = np.insert(data, at[:-1][full], 0x20)
            at = at + np.append(0, np.cumsum(full))
        opens = self._borders(data)
        opens[at[:-1][full]] = True
        start = np.flatnonzero(opens)
        stretches = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(data.tobytes())]).dictionary_encode()
        place, before = stretches.indices.to_numpy(), np.searchsorted(start, at)
        found = self.found(stretches.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        ids = np.frombuffer(b"".join(found), np.int32)
        counts = sizes[place]
        flat = ids[np.repeat((np.cumsum(sizes) - sizes)[place], counts) + _bytes.spans_of(counts)] if len(ids) else ids
        offsets = np.append(0, np.cumsum(counts))[before].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def _borders(self, data: np.ndarray) -> np.ndarray:
        """Where a stretch begins, whatever stands around it."""
        opens = np.zeros(len(data), bool)
        if not self.model.cut or not len(data):
            return opens
        blank = data == 0x20
        opens[1:] = blank[1:] & ~blank[:-1]
        for byte in self.model.alone:
            here = data == byte
            opens |= here
            opens[1:] |= here[:-1]
        # a blank after a literal U+2581 continues its run
        literal = np.flatnonzero((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81)) if len(data) > 3 else []
        opens[np.asarray(literal, np.int64) + 3] &= data[np.asarray(literal, np.int64) + 3] != 0x20
        return opens

    def __call__(self, text: str) -> list[int]:
        """The ids of one text."""
        return self.batch(pa.array([text])).values.to_pylist()


def surfaces(pieces: list[tuple[str, float, int]]) -> pa.Array:
    """The bytes of each id."""

    def one(piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == _UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == _CONTROL else piece.replace(BLANK, " ").encode()

    return pa.array([one(p, t) for p, _, t in pieces], pa.binary())


def _some(batch: pa.RecordBatch, ids: str, most: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` ids each."""
    ends = np.cumsum(batch.column(ids).value_lengths().fill_null(0).to_numpy().astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def decode_lists(table: pa.Array, lists: pa.Array, dummy: bool) -> list[str]:
    """The texts of lists of ids; ``dummy``: the blank before each text goes."""
    joined = table.take(lists.flatten())
    data, at = _bytes.raw(joined)
    begins = at[np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)))]
    raw = data.tobytes()
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        out.append(raw[a + 1 if dummy and a < b and raw[a] == 0x20 else a : b].decode("utf-8", "replace"))
    return out


def encode(docs: DataFrame, model_path: str = MODEL, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text; a column of that name is replaced."""
    docs = docs.drop(name)
    with open(model_path, "rb") as f:  # a vocabulary file of the driver, sent with the function
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data)
        for batch in batches:
            for part in _bytes.slices(batch, text, _SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, encoder.batch(part.column(text))], [*part.schema.names, name])

    return arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, model_path: str = MODEL, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of each list of ids; a column of that name is replaced."""
    df = df.drop(name)
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _, dummy = parsed(data)
        table = surfaces(pieces)
        for batch in batches:
            for part in _some(batch, ids):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decode_lists(table, part.column(ids), dummy), pa.string())], [*part.schema.names, name])

    return arrow(df, run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every document, their number, and whether they decode to its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decode(encode(docs))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(BLANK), F.lit(" "))
    return out.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), same.alias("round_trip"))
