"""Language-model scoring with Brown's class-based n-grams.

Brown et al. (Computational Linguistics 18:4, 1992): P(w | w') = P(c(w) | g(w')) * P(w | c(w)). Every
training word has one class c, found by exchange clustering: a word moves to the class that raises the
likelihood of the training text the most, pass after pass. As in two-sided class models, the class g under which a
word stands as context may differ from the one under which it is predicted, so that g is known
without a look-up, also of words never seen.

Contexts. A type is one of the ``HEAD`` most frequent tokens, or, for any other token, one of ``TAILS`` buckets of
its last bytes and length. Pairs of neighbouring types, at most (HEAD + TAILS + 1)**2 rows whatever
the corpus, are clustered by sequential exchange on the driver: each type's class is g of its tokens, and where
their predicted classes begin.

Words. A stored table has a row for each training token's hash with its counts after each g; it grows with the corpus and
is never collected. Exchange runs over it in passes: given the table N(g, c) of the pass before (CLASSES**2 numbers, the
bound of what goes to the executors and comes back), each word of one half of the words takes the class that gains most,
itself removed; the halves alternate, so that words don't all run after one another. Where a word stands after some
passes follows from its row and the tables of these passes alone: nothing is stored between passes.

Scoring needs class and count of every token. Those of the ``CACHE`` most frequent tokens go to the
executors (20 bytes each); the other tokens are summed for each document and joined with the table of words.

The model's smoothing: class transitions are interpolated with class frequencies by Witten-Bell;
a word's share of its class is (c + 0.5) / (N_c + 0.5 * (V_c + 1)), whose last 0.5 is for words never
seen, which are taken to be of their type's class.

Cases: a null text is an empty one and has its end token alone; repeated rows are scored each and
learnt from each; a null doc_id is held out of learning (its crc32 is null); no training rows at all
give N = V = 0; extra columns are ignored; an empty table gives an empty result. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import _bytes
from lodeweave.llm._store import arrow, forget, stored

HEAD = 1500
TAILS = 500
CLASSES = 64
#: Rounds of the driver's exchange over types at most, and passes over all words (each moves one half of them).
ROUNDS = 4
PASSES = 4
#: What a move over all words must gain in log-likelihood: without it, words seen once or twice follow chance.
MARGIN = 4.0
CACHE = 200_000
#: Counts that a task holds before it hands them on.
_HELD = 1 << 20
#: The end token's hash: no token has it (a token's hash is mixed from one byte at least).
END = np.uint64(0)


def in_training(doc_id: Column, modulus: int = 5, remainder: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) != remainder, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, tail bucket and text of each token, in order, each text's end included."""
    w = _bytes.words(column, _bytes.DENSE)
    n, texts = len(w.start), len(column)
    doc = w.doc
    h = np.zeros(n + texts, np.uint64)
    tail = np.full(n + texts, TAILS, np.int32)
    at = np.arange(n) + doc
    h[at] = w.hashes()
    last = w.start + w.length - 1
    look = w.data[last].astype(np.uint64) * np.uint64(257) + w.data[np.maximum(last - 1, w.start)].astype(np.uint64)
    look = look * np.uint64(7) + np.minimum(w.length, 18).astype(np.uint64) // np.uint64(3)
    tail[at] = (_bytes.mix(look) % np.uint64(TAILS)).astype(np.int32)
    return h, tail, np.repeat(np.arange(texts), np.diff(w.before) + 1)


def _folded(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, code, n) with each (key, code) once."""
    key, code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((code, key))
    key, code, n = key[order], code[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    return key[first], code[first], np.add.reduceat(n, first) if len(first) else n


def _counted(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """(key, code, n) of what ``keys_of`` gives for each part of a batch, summed within the task as far as memory allows."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def batch_of(k: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int32)), pa.array(n)], ["key", "code", "n"])

    for batch in batches:
        for part in _bytes.slices(batch, "text"):
            key, code = keys_of(part.column("text"))
            parts.append(_folded([(key, code, np.ones(len(key), np.int64))]))
            if sum(len(p[0]) for p in parts) > _HELD:
                parts = [_folded(parts)]
                if len(parts[0][0]) > _HELD // 2:
                    yield batch_of(*parts.pop())
    if parts:
        yield batch_of(*_folded(parts))


_COUNTS = "key bigint, code int, n bigint"


def token_counts(docs: DataFrame) -> DataFrame:
    """(key, n): how often each token's hash occurs in all texts."""

    def keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, _, _ = tokens(column)
        return h.view(np.int64), np.zeros(len(h), np.int32)

    return arrow(docs.select("text"), lambda b: _counted(b, keys_of), _COUNTS).groupBy("key").agg(F.sum("n").alias("n"))


def _before(of: np.ndarray, doc: np.ndarray, texts: int, end: int) -> np.ndarray:
    """What stands before each token; before a text's first one an end."""
    before = np.empty_like(of)
    before[1:] = of[:-1]
    before[np.searchsorted(doc, np.arange(texts))] = end
    return before


@dataclass(frozen=True)
class Types:
    """The types: keys of the most frequent tokens, sorted; a token's type is its place, or HEAD + bucket."""

    head: np.ndarray

    @property
    def size(self) -> int:
        return len(self.head) + TAILS + 1  # buckets, and the end

    def of(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        key = h.view(np.int64)
        out = tail.astype(np.int64) + len(self.head)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, key), len(self.head) - 1)
            found = self.head[at] == key
            out[found & (tail < TAILS)] = at[found & (tail < TAILS)]
        return out


def pair_counts(docs: DataFrame, types: Types) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left type, right type and count of neighbours; a text begins after an end."""

    def keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, tail, doc = tokens(column)
        t = types.of(h, tail)
        return _before(t, doc, len(column), types.size - 1) * types.size + t, np.zeros(len(t), np.int32)

    out = arrow(docs.select("text"), lambda b: _counted(b, keys_of), _COUNTS)
    got = out.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    return key // types.size, key % types.size, n.astype(np.float64)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, size: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Each type's class, by exchange clustering (Martin, Liermann and Ney, 1998).

    Types begin dealt over the classes by frequency; in turn, from the most frequent on, each moves to
    the class with the largest sum of N(c,d) log N(c,d) - 2 N(c) log N(c), ties to the smaller class.
    The last type (the end) keeps a class of its own.
    """
    total = np.bincount(right, n, size)
    order = np.argsort(-total, kind="stable")
    order = order[(order != size - 1) & (total[order] > 0)]
    own = classes - 1
    c = np.full(size, 0)
    c[order] = np.arange(len(order)) % own
    c[size - 1] = own
    pairs = np.bincount(c[left] * classes + c[right], n, classes * classes).reshape(classes, classes)
    sums = np.bincount(c, total, classes)
    by_right, by_left = np.argsort(right, kind="stable"), np.argsort(left, kind="stable")
    at_right, at_left = np.searchsorted(right[by_right], np.arange(size + 1)), np.searchsorted(left[by_left], np.arange(size + 1))
    for _ in range(rounds):
        moved = 0
        for t in order:
            ins, outs = by_right[at_right[t] : at_right[t + 1]], by_left[at_left[t] : at_left[t + 1]]
            self_n = n[ins][left[ins] == t].sum()
            ins, outs = ins[left[ins] != t], outs[right[outs] != t]
            into = np.bincount(c[left[ins]], n[ins], classes)
            outof = np.bincount(c[right[outs]], n[outs], classes)
            was = c[t]
            pairs[:, was] -= into
            pairs[was, :] -= outof
            pairs[was, was] -= self_n
            sums[was] -= total[t]
            # adding t to class k changes column k by ``into``, row k by ``outof``, and the corner by both
            gain = (_xlogx(pairs + into[:, None]) - _xlogx(pairs)).sum(axis=0) + (_xlogx(pairs + outof[None, :]) - _xlogx(pairs)).sum(axis=1)
            corner = np.diag(pairs)
            gain += _xlogx(corner + into + outof + self_n) - _xlogx(corner + into) - _xlogx(corner + outof) + _xlogx(corner)
            gain -= 2 * (_xlogx(sums + total[t]) - _xlogx(sums))
            to = int(np.argmax(gain[:own]))
            c[t] = to
            moved += to != was
            pairs[:, to] += into
            pairs[to, :] += outof
            pairs[to, to] += self_n
            sums[to] += total[t]
        if not moved:
            break
    return c


def word_table(docs: DataFrame, types: Types, klass: np.ndarray, classes: int) -> DataFrame:
    """(key, first, g, n) of every token's hash: the class it begins in, and how often it follows each context class; stored."""

    def keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, tail, doc = tokens(column)
        g = klass[types.of(h, tail)]
        return h.view(np.int64), _before(g, doc, len(column), klass[-1]) * classes + g

    # dealt by key once: both aggregations below keep that partitioning
    pairs = arrow(docs.select("text"), lambda b: _counted(b, keys_of), _COUNTS).repartition("key").groupBy("key", "code").agg(F.sum("n").alias("n"))
    row = F.array_sort(F.collect_list(F.struct((F.col("code") / classes).cast("int").alias("g"), "n")))
    rows = pairs.groupBy("key").agg(F.min(F.col("code") % classes).cast("int").alias("first"), row.alias("x"))
    return stored(rows.select("key", "first", F.col("x.g").alias("g"), F.col("x.n").alias("n")), "lm-words")


#: Counts up to which gains are looked up, and entries that are weighed at once.
_SMALL, _ENTRIES = 8, 1 << 14


class Passes:
    """Where words stand after some passes of exchange, from the tables N(g, c) of these passes."""

    def __init__(self, tables: list[np.ndarray], margin: float | None = None):
        self.tables, self.margin = tables, MARGIN if margin is None else margin

    def classes(self, key: np.ndarray, first: np.ndarray, size: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each word's class; ``size``: how many of the entries (g, n), in order, are the word's."""
        c = first.copy()
        begin = np.cumsum(size) - size
        for p, table in enumerate(self.tables):
            movers = np.flatnonzero((_bytes.mix(key.view(np.uint64)) & np.uint64(1) == p % 2) & (key != END.view(np.int64)))
            ends = np.cumsum(size[movers])
            i = 0
            small = np.arange(_SMALL + 1)[:, None, None]
            looked = _xlogx(table + small) - _xlogx(table)
            own = _xlogx(table) - _xlogx(np.maximum(table - small, 0))
            while i < len(movers):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _ENTRIES, "right")))
                some = movers[i:j]
                c[some] = self._best(table, looked, own, c[some], size[some], np.repeat(begin[some], size[some]) + _bytes.spans_of(size[some]), g, n)
                i = j
        return c

    def _best(self, table: np.ndarray, looked: np.ndarray, own: np.ndarray, was: np.ndarray, size: np.ndarray, at: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The class of the largest gain for each word, itself removed from the one where it stands; ties to the smaller; a word stays unless ``margin`` is gained."""
        g, n, stood = g[at], n[at], np.repeat(was, size)
        gain = looked[np.minimum(n, _SMALL), g]
        rows = np.arange(len(at))
        gain[rows, stood] = own[np.minimum(n, _SMALL), g, stood]
        many = np.flatnonzero(n > _SMALL)
        there = table[g[many]]
        gain[many] = _xlogx(there + n[many, None]) - _xlogx(there)
        held = table[g[many], stood[many]]
        gain[many, stood[many]] = _xlogx(held) - _xlogx(np.maximum(held - n[many], 0))
        first = np.cumsum(size) - size
        total, sums = np.add.reduceat(n, first).astype(np.float64), table.sum(axis=0)
        cost = _xlogx(sums + total[:, None]) - _xlogx(sums)
        cost[np.arange(len(was)), was] = _xlogx(sums[was]) - _xlogx(np.maximum(sums[was] - total, 0))
        score = np.round(np.add.reduceat(gain, first) - cost, 6)[:, :-1]
        best = np.argmax(score, axis=1)
        row = np.arange(len(was))
        return np.where(score[row, best] >= score[row, was] + self.margin, best, was).astype(was.dtype)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    lists = batch.column("g")
    return (batch.column("key").to_numpy(), batch.column("first").to_numpy(), lists.value_lengths().to_numpy(),
            lists.flatten().to_numpy(), batch.column("n").flatten().to_numpy())


def class_pairs(words: DataFrame, tables: list[np.ndarray], classes: int) -> np.ndarray:
    """N(g, c) after the passes of ``tables``: at most classes**2 rows come to the driver."""
    passes = Passes(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(classes * classes, np.int64)
        for batch in batches:
            key, first, size, g, n = _columns(batch)
            c = passes.classes(key, first, size, g, n)
            np.add.at(out, g.astype(np.int64) * classes + np.repeat(c, size), n)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

    got = arrow(words, run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(got.column("at").to_numpy(), got.column("n").to_numpy(), classes * classes).reshape(classes, classes)


def assigned(words: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """(key, class, n) of every word after the passes; stored."""
    passes = Passes(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, first, size, g, n = _columns(batch)
            c = passes.classes(key, first, size, g, n)
            total = np.add.reduceat(n, np.cumsum(size) - size) if len(n) else n
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(c.astype(np.int32)), pa.array(total)], ["key", "class", "n"])

    return stored(arrow(words, run, "key bigint, class int, n bigint"), "lm-classes")


@dataclass(frozen=True)
class Model:
    """Types and their classes; log10 of class transitions; the log10 divisor of a class's words; words, the most frequent ones here."""

    types: Types
    klass: np.ndarray
    transition: np.ndarray
    divisor: np.ndarray
    total: int
    distinct: int
    words: DataFrame
    cache: tuple[np.ndarray, np.ndarray, np.ndarray]
    tables: tuple[np.ndarray, ...] = ()


def _transitions(pairs: np.ndarray) -> np.ndarray:
    """log10 P(d | c), Witten-Bell: N(c) and the number of classes seen after c weigh the two sides."""
    k = len(pairs)
    sums, seen = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    unigram = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * k)
    seen = np.maximum(seen, 1)
    return np.log10((pairs + seen * unigram) / (sums + seen))


def fit(docs: DataFrame, head: int = HEAD, cache: int = CACHE, classes: int = CLASSES, passes: int = PASSES) -> Model:
    """The model of all ``docs`` (text)."""
    top = token_counts(docs).where(F.col("key") != int(END.view(np.int64))).orderBy(F.desc("n"), "key").limit(head).toArrow()
    types = Types(np.sort(top.column("key").to_numpy().astype(np.int64)))
    left, right, many = pair_counts(docs, types)
    klass = exchange(left, right, many, types.size, classes).astype(np.int32)
    words = word_table(docs, types, klass, classes)
    tables = [class_pairs(words, [], classes)]
    for _ in range(passes):
        tables.append(class_pairs(words, tables, classes))
    known = assigned(words, tables[:-1])
    forget(words)
    pairs = tables[-1]
    v = np.zeros(classes)
    for r in known.groupBy("class").count().collect():  # a row for each class
        v[r["class"]] = r["count"]
    got = known.orderBy(F.desc("n"), "key").limit(cache).toArrow()
    key, c, n = (got.column(x).to_numpy() for x in ("key", "class", "n"))
    order = np.argsort(key)
    return Model(types, klass, _transitions(pairs), np.log10(pairs.sum(axis=0) + 0.5 * (v + 1)), int(pairs.sum()), int(v.sum()), known, (key[order], c[order], n[order]), tuple(tables))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    unknown = float(np.log10(0.5))
    base = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    # a row's own key, so that repeated ids and null ids stay rows of their own
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    key, of, n = model.cache
    log_n = np.log10(n + 0.5)
    types, klass, transition, divisor = model.types, model.klass, model.transition, model.divisor
    classes = len(divisor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bytes.slices(batch, "text"):
                texts = part.num_rows
                h, tail, doc = tokens(part.column("text"))
                k = h.view(np.int64)
                at = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
                hit = key[at] == k if len(key) else np.zeros(len(k), bool)
                g = klass[types.of(h, tail)]
                before = _before(g, doc, texts, klass[-1])
                # tokens that aren't in the cache are taken for unknown ones here; what is known of them is added below
                c, log_of = g.copy(), np.full(len(k), unknown)
                if len(key):
                    c[hit], log_of[hit] = of[at[hit]], log_n[at[hit]]
                shape = np.bincount(doc, transition[before, c] - divisor[c] + log_of, texts)
                logs = np.bincount(doc, log_of, texts)
                size, known = np.bincount(doc, minlength=texts), np.bincount(doc[hit], minlength=texts)
                # of the rest, each document's different (token, context, type's class) and how often each occurs
                rest, far, code = doc[~hit], k[~hit], before[~hit] * classes + g[~hit]
                order = np.lexsort((code, far, rest))
                rest, far, code = rest[order], far[order], code[order]
                new = np.ones(len(far), bool)
                new[1:] = (rest[1:] != rest[:-1]) | (far[1:] != far[:-1]) | (code[1:] != code[:-1])
                first = np.flatnonzero(new)
                often = np.diff(np.append(first, len(far)))
                at_doc = pa.array(np.searchsorted(rest[first], np.arange(texts + 1)).astype(np.int32))
                listed = lambda x, kind: pa.ListArray.from_arrays(at_doc, pa.array(x.astype(kind)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_row"), pa.array(size), pa.array(known), pa.array(logs), pa.array(shape), listed(far[first], np.int64), listed(code[first], np.int32), listed(often, np.int32)],
                    ["doc_id", "_row", "n_tokens", "known", "logs", "shape", "keys", "codes", "often"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    light = stored(arrow(rows, run, f"doc_id {id_type}, _row bigint, n_tokens bigint, known bigint, logs double, shape double, keys array<bigint>, codes array<int>, often array<int>"), "lm-rows")
    far = light.select("_row", F.explode(F.arrays_zip("keys", "codes", "often")).alias("x")).select("_row", F.col("x.keys").alias("key"), F.col("x.codes").alias("code"), F.col("x.often").alias("often"))
    # log10 P(c | g) less the divisor of c, a literal of classes**2 numbers
    literal = F.split(F.lit(",".join(map(repr, (transition - divisor).ravel().tolist()))), ",").cast("array<double>")
    share = lambda g, c: F.element_at(literal, (g * classes + c + 1).cast("int"))
    context = F.floor(F.col("code") / classes)
    more = F.log10(F.col("n") + 0.5) - unknown
    other = share(context, F.col("class")) - share(context, F.col("code") % classes)
    found = far.join(model.words, "key").groupBy("_row").agg(F.sum("often").alias("more"), F.sum(F.col("often") * more).alias("more_logs"), F.sum(F.col("often") * (more + other)).alias("more_shape"))
    out = light.drop("keys", "codes", "often").join(found, "_row", "left").na.fill(0, ["more", "more_logs", "more_shape"])
    return out.select("doc_id", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
                      (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * base).alias("base_score"), (F.col("shape") + F.col("more_shape")).alias("score"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, token numbers, base_score, score and perplexity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(in_training(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), *out.columns[1:], F.pow(F.lit(10.0), F.least(-F.col("score") / F.col("n_tokens"), F.lit(300.0))).alias("perplexity"))
