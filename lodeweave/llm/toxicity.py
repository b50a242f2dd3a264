"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: words, words cut to their first 4 to 8 bytes (so that
rare inflections share a weight), pairs of neighbours, and pairs with one word between; all hashed
into 2**BITS buckets. FTRL-proximal (McMahan et al., KDD 2013) gives every coordinate its own rate
and, by its L1 term, leaves most weights at zero: the model is a short list of (bucket, weight).

Training reads at most ``SAMPLE`` labelled rows (those with the smallest hash of their id) with at most
``FEATURES`` features in all, documented bounds, in one task, since the learner is sequential; features are made where the texts
lie. Scoring is a projection of every whole text, with no shuffle.

Cases: a null text is an empty one; an empty text scores the model's bias; labels that are null
are left out; if an id has several labels the largest holds; of several texts of a labelled id one is learnt,
whatever their number; repeated documents are scored each; a null id isn't held out and has no label; a column of
the input named like the score is replaced; an empty table gives an empty result; with no
labels at all every score is 0.5. Extra columns are ignored by ``fit`` and ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.llm import _bytes
from lodeweave.llm._store import arrow

BITS = 20
SAMPLE = 12_000
#: Features of the learnt rows in all: what the learner's task holds, 4 bytes each.
FEATURES = 32_000_000
EPOCHS = 4
THRESHOLD = 0.3
_STEMS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Model:
    """Weights that aren't zero, by bucket, and the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every feature, repeated ones included, one family of features after the other."""
    w = _bytes.words(column, _bytes.WORD)
    h, doc = w.hashes(), w.doc.astype(np.int32)

    def hashed(x: np.ndarray) -> np.ndarray:
        return (_bytes.mix(x) >> np.uint64(64 - bits)).astype(np.int32)

    yield doc, hashed(h)
    for k in _STEMS:
        long = w.length > k
        yield doc[long], hashed(w.hashes(k)[long] + np.uint64(k))
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xD1B54A32D192ED03)):
        same = doc[gap:] == doc[:-gap]
        yield doc[gap:][same], hashed((h[:-gap] * np.uint64(salt) + h[gap:])[same])


def folded(column: pa.Array, bits: int, table: np.ndarray | None = None) -> np.ndarray:
    """Sorted (text << bits | bucket) of each text's distinct features; with a ``table`` those alone whose weight isn't zero."""
    both = np.empty(0, np.int64)
    for doc, bucket in features(column, bits):
        if table is not None:
            hit = np.flatnonzero(table[bucket])
            doc, bucket = doc[hit], bucket[hit]
        both = np.union1d(both, doc.astype(np.int64) << bits | bucket)
    return both


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1e-3, epochs: int = EPOCHS) -> Model:
    """Weights for (buckets present, label) rows, taken in the given order; the bias has no L1 term."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        cut = np.where(at == bias, 0.0, l1)
        return np.where(np.abs(zi) <= cut, 0.0, -(zi - np.sign(zi) * cut) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, label in rows:
            at = np.append(at, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    kept = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Model(kept.astype(np.int32), weights(kept).astype(np.float32), float(weights(np.array([bias]))[0]), bits)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """The model of at most ``sample`` labelled documents: docs (doc_id, text), labels (doc_id, toxic)."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(order, "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers: the bound of this broadcast; of several texts of an id the one with the smallest hash is learnt
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bytes.slices(batch, "text"):
                both = folded(part.column("text"), bits)
                at = np.searchsorted(both >> bits, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((both & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], ["doc_id", "label", "buckets"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, rows, held = np.empty(FEATURES, np.int32), [], 0  # memory is taken as it is filled
        for batch in batches:
            values = batch.column("buckets")
            at, flat, y = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False), batch.column("label").to_pylist()
            fits = int(np.searchsorted(at[1:] - at[0] + held, FEATURES, "right"))
            fits = min(fits, batch.num_rows)
            buckets[held : held + at[fits] - at[0]] = flat[at[0] : at[fits]]
            rows += [(buckets[held + at[i] - at[0] : held + at[i + 1] - at[0]], y[i]) for i in range(fits)]
            held += int(at[-1] - at[0])
            if held > FEATURES:
                break
        if rows:
            m = ftrl(rows, bits, epochs=epochs)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(m.bucket, -1).astype(np.int32)), pa.array(np.append(m.weight, m.bias).astype(np.float64))], ["bucket", "weight"])

    ready = arrow(texts, featured, "doc_id bigint, label int, buckets array<int>")
    one = ready.repartition(1).sortWithinPartitions(order, "doc_id", "buckets")
    out = arrow(one, learned, "bucket int, weight double").toPandas()
    b, w = out.bucket.to_numpy(), out.weight.to_numpy()
    return Model(b[b >= 0], w[b >= 0].astype(np.float32), float(w[b < 0][0]) if len(b) else 0.0, bits)


def scores(column: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each text; ``table``: the weight of each bucket."""
    both = folded(column, model.bits, table)
    total = np.bincount(both >> model.bits, table[both & ((1 << model.bits) - 1)], len(column)) + model.bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with each whole text's score; a column of that name is replaced."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << model.bits, np.float32)
        table[model.bucket] = model.weight
        for batch in batches:
            for part in _bytes.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(part.column("text"), model, table))], [*part.schema.names, name])

    return arrow(docs, run, schema)


def held_out(modulus: int = 4, remainder: int = 2):
    """Whether a row is held out of learning; a row without an id isn't, and has no label to learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def fit_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of ``labels``, learnt from the rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    return fit(docs, labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_tables(spark, docs, sf_dir)
    scored = score(docs, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
