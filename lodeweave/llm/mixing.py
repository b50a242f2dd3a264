"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equal size.

Sizes are words. Sources, in the order of their names with null last, share all words by weight; none
gets more than ``most`` times its own, and what that leaves is shared by the others. The schedule is a row
of slots: slot i is the point (i * golden ratio) modulo 1, in 64 bits, and belongs to the source in whose
share of the cumulative targets the point falls, so that every stretch of the schedule has each
source near its share. A source's slots are ranked; its documents, in the order of a hash, are one
stream of words cut into blocks of ``BLOCK``; the slot of rank r takes block r modulo the number of blocks,
in pass r div that number. A source that has its target takes no more slots, its last slot is cut
to fit, and the few words that a source is short of in the end get slots of their own behind the
others: a source takes its target rounded down, exactly.

Documents are ordered without sorting a source: a hash deals them into buckets of some ``BUCKET`` rows,
buckets are added up for each source, and only a bucket is sorted. Slots are ranked likewise, by
stretches of ``STRETCH``. What is moved are ids, sizes and hashes, never texts. The sources and their targets are known to
every task, so they are bounded: more than ``SOURCES`` raise ValueError.

Cases: null texts and texts without words have size 0 and are taken 0 words of; null ids and null sources are
values; repeated rows are documents of their own; a source without words has target 0; an empty table
gives an empty result. Columns other than id, text and source are ignored. The same rows give the same
result, however they are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm._bytes import DENSE, slices, words
from lodeweave.llm._store import arrow, forget, stored

WEIGHTS = (1, 2, 3)
#: Times that a source's words may be taken.
MOST = 3
BLOCK = 512
BUCKET = 20_000
STRETCH = 1 << 16
SOURCES = 1_000_000
#: 2**64 divided by the golden ratio, made odd.
GOLDEN = 0x9E3779B97F4A7C15


@dataclass
class Plan:
    """Sources in their order: name, words, target, and the whole words that the mix takes."""

    names: list
    sizes: list[int]
    targets: list[float]
    block: int

    @property
    def goals(self) -> list[int]:
        return [int(t) for t in self.targets]

    @property
    def blocks(self) -> list[int]:
        return [-(-s // self.block) for s in self.sizes]

    @property
    def needed(self) -> list[int]:
        """Slots that a source takes: whole passes and the blocks of the last one."""
        return [g // s * b + -(-(g % s) // self.block) if g else 0 for g, s, b in zip(self.goals, self.sizes, self.blocks)]

    @property
    def slots(self) -> int:
        return -(-sum(self.goals) // self.block)

    def ends(self) -> np.ndarray:
        """Where each source's share of the points ends but for the last one's."""
        total, ends, at = sum(self.goals), [], 0
        for g in self.goals:
            at += g
            ends.append((at << 64) // total if total else 0)
        return np.array([min(e, (1 << 64) - 1) for e in ends[:-1]], np.uint64)


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of all sizes by weight, none above ``most`` times its size, the excess shared by the others."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * left > most * sizes[i] * total}
        if not full:
            for i in open_:
                out[i] = weights[i] * left / total
            return out
        for i in full:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ = [i for i in open_ if i not in full]
    return out


def points(first: int, n: int) -> np.ndarray:
    """The points of slots first, first + 1, ... as fractions of 2**64."""
    return (np.arange(n, dtype=np.uint64) + np.uint64(first)) * np.uint64(GOLDEN)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, key (decides the order within a source), size of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                size = np.diff(words(part.column(3), DENSE).before)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(size.astype(np.int64))], ["doc_id", "source", "key", "size"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), key.alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    return arrow(rows, run, f"doc_id {kind}, source string, key string, size bigint")


def plan(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> Plan:
    """The sources of ``sized`` documents and what the mix takes of each."""
    by = documents.groupBy("source").agg(F.sum("size").alias("size"))
    rows = by.limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"there are more than {SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    return Plan([r["source"] for r in rows], sizes, targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most), block)


def placed(documents: DataFrame, made: Plan) -> DataFrame:
    """``sized`` documents of one word or more with source_no and start, the words before it in its source's stream."""
    spark = documents.sparkSession
    names = spark.createDataFrame([(i, x) for i, x in enumerate(made.names)], "source_no int, source string")
    buckets = max(1, -(-documents.count() // BUCKET))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32))
    rows = documents.where("size > 0").join(F.broadcast(names.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", bucket)
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("s")).select("source_no", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ahead, ["source_no", "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.select("doc_id", "source", "source_no", "size", "start")


def schedule(spark: SparkSession, made: Plan) -> DataFrame:
    """slot, source_no, rank: the slots that are used; those behind the last point fill up what sources are short of."""
    ends, need, n = made.ends(), np.array(made.needed, np.int64), made.slots

    def owners(stretch: int) -> np.ndarray:
        return np.searchsorted(ends, points(stretch * STRETCH, min(STRETCH, n - stretch * STRETCH)), side="right")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                which, k = np.unique(owners(i), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), i)), pa.array(which.astype(np.int32)), pa.array(k)], ["stretch", "source_no", "n"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order, owner = -1, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for stretch, source, ahead in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if stretch != known:
                    owner = owners(stretch)
                    known, order = stretch, np.argsort(owner, kind="stable")
                    owner = owner[order]
                at = order[np.searchsorted(owner, source) : np.searchsorted(owner, source, "right")]
                at = at[: max(0, int(need[source]) - ahead)]
                yield pa.RecordBatch.from_arrays([pa.array(stretch * STRETCH + at), pa.array(np.full(len(at), source, np.int32)), pa.array(ahead + np.arange(len(at)))], ["slot", "source_no", "rank"])

    tasks = max(1, min(-(-n // STRETCH), spark.sparkContext.defaultParallelism * 4))
    some = stored(arrow(spark.range(0, -(-n // STRETCH), numPartitions=tasks), counts, "stretch bigint, source_no int, n bigint"), "slots")
    before = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = some.select("stretch", "source_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).repartition("stretch").sortWithinPartitions("stretch", "source_no")
    used = arrow(ahead, ranked, "slot bigint, source_no int, rank bigint")
    have = {r["source_no"]: r["n"] for r in some.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    short, at = [], n
    for s, k in enumerate(need.tolist()):
        if k > (h := have.get(s, 0)):
            short.append((s, h, k, at))
            at += k - h
    if not short:
        return used
    more = spark.createDataFrame(short, "source_no int, first bigint, past bigint, at bigint").withColumn("rank", F.explode(F.sequence("first", F.col("past") - 1)))
    return used.union(more.select((F.col("at") + F.col("rank") - F.col("first")).alias("slot"), "source_no", "rank"))


def joined(documents: DataFrame, slots: DataFrame, made: Plan) -> DataFrame:
    """slot, source_no, doc_id, size, start, from_word, words: the pieces of documents (from their word ``from_word`` on) that each slot takes, cut at the source's goal."""
    spark, b = documents.sparkSession, made.block
    known = F.broadcast(spark.createDataFrame([(i, s, k, g) for i, (s, k, g) in enumerate(zip(made.sizes, made.blocks, made.goals)) if g], "source_no int, length bigint, blocks bigint, goal bigint"))
    pieces = documents.withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
    low, high = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    pieces = pieces.select("source_no", "block", "doc_id", "size", "start", low.alias("low"), high.alias("high"))
    slots = slots.join(known, "source_no").select("slot", "source_no", F.expr("rank % blocks").alias("block"), (F.col("goal") - F.expr("rank div blocks") * F.col("length")).alias("until"))
    taken = F.least(F.col("high"), F.col("until")) - F.col("low")
    return pieces.join(slots, ["source_no", "block"]).where(taken > 0).select("slot", "source_no", "doc_id", "size", "start", (F.col("low") - F.col("start")).alias("from_word"), taken.alias("words"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame, Plan]:
    """(``sized`` documents, ``placed`` ones, the pieces of ``joined``, the plan); the order of the mix is that of slot and start."""
    documents = stored(sized(docs, doc_id, text, source), "sized")
    made = plan(documents, weights, most, block)
    where = stored(placed(documents, made), "placed")
    return documents, where, joined(where, schedule(docs.sparkSession, made), made), made


def totals(documents: DataFrame, where: DataFrame, pieces: DataFrame, made: Plan) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document."""
    spark = documents.sparkSession
    none = where.select("source_no", "doc_id", "size", "start", F.lit(0).cast("bigint").alias("words"))
    taken = pieces.select("source_no", "doc_id", "size", "start", "words").union(none).groupBy("source_no", "doc_id", "size", "start").agg(F.sum("words").alias("taken"))
    known = spark.createDataFrame([(i, x, s, t) for i, (x, s, t) in enumerate(zip(made.names, made.sizes, made.targets))], "source_no int, source string, source_size bigint, target double")
    out = taken.join(F.broadcast(known), "source_no").select("doc_id", "source", "size", "source_size", "target", "taken")
    empty = documents.where("size = 0").withColumnRenamed("source", "_source").join(F.broadcast(known), F.col("_source").eqNullSafe(F.col("source")))
    return out.union(empty.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents, with weights 1, 2, 3 in turn, takes of each."""
    documents, where, pieces, made = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = stored(totals(documents, where, pieces, made).select("doc_id", "size", "source_size", "target", "taken"), "mix")
    forget(documents, where)
    return out


OP12_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), o AS (
  SELECT *, sum(size) OVER () AS total, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left, sum(size) OVER () - 3 * coalesce(sum(size) OVER b, 0) AS left_over
  FROM s WINDOW b AS (ORDER BY size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, 3 * size * weight_left < weight * left_over AS full_ FROM o
), f AS (
  SELECT sum(weight) FILTER (NOT full_) AS w, any_value(total) - 3 * coalesce(sum(size) FILTER (full_), 0) AS left_over FROM c
), t AS (
  SELECT source, size AS source_size, CASE WHEN full_ THEN CAST(3 * size AS DOUBLE) ELSE CAST(weight * f.left_over AS DOUBLE) / CAST(f.w AS DOUBLE) END AS target FROM c, f
), p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(size, goal % source_size - start)) END AS BIGINT) AS taken
FROM p
"""
