"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate in blocks of integers. Each pass sums, over all
partitions, how many scores fall into each bin of a query's range; the bin that holds the k-th
largest score becomes the next pass's range, until a bin is one score wide and so is the k-th
largest score itself. A last pass keeps the scores above it, and of those equal to it the smallest
ids; a window over the few rows left ranks them.

A partition reports only its highest bins, down to the one that holds its own k-th largest score,
since the global one can't lie below: at most k rows a query from each task, however many
candidates score alike. Queries are taken in blocks of at most ``BLOCK`` rows (the bound of what is
sent to the executors); candidates are never moved.

Cases: vectors that are null, or hold a null or non-finite component, take no part; shorter vectors
are padded with zeros; the rows that carry the query's id aren't its candidates, any other row is,
repeated ones each; of several rows with one query id the one with the smallest vector asks; ties go
to the smaller id; fewer than k candidates give fewer rows; an empty table gives an empty result.
A score has 64 bits: where the length of a scaled query times that of the longest candidate reaches 2**62, ValueError is raised before
anything is scored. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm._store import arrow, stored

BINS = 256
BLOCK = 4096
SCALE = 256
#: What scores must stay below, so that ranges of scores fit 64 bits too.
_MOST = float(1 << 62) * (1 - 1e-6)
#: Candidates that are scored at once: with BLOCK queries some 8 MB a temporary, as a block's histograms take.
_ROWS = 256
_OUT = "query_id bigint, vec_id bigint, score bigint"


def _whole(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as whole float64 numbers, padded to ``width``."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    length = np.diff(column.offsets.to_numpy())
    if (length == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), max(width, int(length.max(initial=0)))))
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out[:, :width]


class _Scores:
    """Scores of batches of candidates against a block of queries; pickled to the executors."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, scale: float, exact: bool):
        self.ids, self.queries, self.scale, self.exact = ids, queries, scale, exact

    def over(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, scores, which scores count) for so many candidates at a time."""
        q = self.queries.T.copy() if self.exact else self.queries.T.astype(np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                m = _matrix(part.column(1), self.queries.shape[1], self.scale)
                score = (m @ q if self.exact else m.astype(np.int64) @ q).astype(np.int64)
                at = np.searchsorted(self.ids, ids)
                own = np.flatnonzero((at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == ids))
                counts = np.ones(score.shape, bool)
                counts[own, at[own]] = False
                yield ids, score, counts


def _tops(hist: np.ndarray, k: int) -> np.ndarray:
    """Bins that aren't empty and have fewer than k scores above them."""
    above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
    return (hist > 0) & (above < k)


def _histogram(cands: DataFrame, scores: _Scores, low: np.ndarray, high: np.ndarray, width: np.ndarray, k: int) -> dict[int, list[tuple[int, int]]]:
    """For each query its highest bins and their counts over all candidates, from the highest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(scores.ids)
        hist = np.zeros(n * BINS, np.int64)
        for _, s, counts in scores.over(batches):
            b = (s - low) // width
            b = np.where(counts & (s >= low) & (s <= high), b + np.arange(n) * BINS, -1).ravel()
            hist += np.bincount(b[b >= 0], minlength=n * BINS)
        q, b = np.nonzero(_tops(hist.reshape(n, BINS), k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(hist.reshape(n, BINS)[q, b])], ["q", "bin", "n"])

    summed = arrow(cands, run, "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    # fewer than k scores lie above a row that stays: at most k rows a query come to the driver
    rows = summed.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < k).collect()
    out: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r["q"], -r["bin"])):
        out.setdefault(r["q"], []).append((r["bin"], r["n"]))
    return out


def _thresholds(cands: DataFrame, scores: _Scores, bound: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each query (the least possible one if there are fewer)."""
    low, high = -bound - 1, bound + 1
    need = np.full(len(bound), k)
    while True:
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        found = _histogram(cands, scores, low, high, width, int(need.max()))
        for q in range(len(bound)):
            left = need[q]
            for b, n in found.get(q, []):
                if n >= left:
                    low[q], high[q], need[q] = low[q] + b * width[q], low[q] + (b + 1) * width[q] - 1, left
                    break
                left -= n
            else:  # fewer than k candidates: all of them stay
                low[q] = high[q] = -bound[q] - 1
        if (width == 1).all():
            return low


def _kept(cands: DataFrame, scores: _Scores, least: np.ndarray, k: int) -> DataFrame:
    """Rows above each query's k-th score, and of those equal to it each task's k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, v, s = (np.empty(0, np.int64) for _ in range(3))
        for ids, score, counts in scores.over(batches):
            at, query = np.nonzero(counts & (score >= least))
            q, v, s = np.append(q, query), np.append(v, ids[at]), np.append(s, score[at, query])
            if len(q):
                order = np.lexsort((v, -s, q))
                q, v, s = q[order], v[order], s[order]
                first = np.searchsorted(q, q)
                near = np.arange(len(q)) - first < k
                q, v, s = q[near], v[near], s[near]
        yield pa.RecordBatch.from_arrays([pa.array(scores.ids[q].astype(np.int64)), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return arrow(cands, run, _OUT)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query."""
    clean = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null").where(_whole(F.col("v")))
    asked = queries.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null").where(_whole(F.col("v")))
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    spark = vectors.sparkSession
    floored = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    norm = F.sqrt(F.aggregate(floored, F.lit(0.0), lambda a, x: a + x * x))
    longest, width = clean.agg(F.max(norm), F.max(F.size("v"))).first()
    parts, last = [], None
    while longest is not None:
        rows = (asked if last is None else asked.where(F.col("vec_id") > last)).orderBy("vec_id").limit(block).toArrow()
        if not rows.num_rows:
            break
        ids = rows.column("vec_id").to_numpy()
        last = int(ids[-1])
        column = rows.column("v").combine_chunks()
        matrix = _matrix(column if isinstance(column, pa.Array) else column.chunk(0), width, scale)
        if not float(np.maximum(np.sqrt((matrix**2).sum(axis=1)), 1.0).max()) * longest < _MOST:
            raise ValueError("scores don't fit 64 bits: scale the vectors down")
        bound = np.ceil(np.sqrt((matrix**2).sum(axis=1)) * longest * (1 + 1e-9)).astype(np.int64) + 1
        scores = _Scores(ids, matrix, scale, exact=bool(bound.max() < 1 << 52))
        kept = _kept(clean, scores, _thresholds(clean, scores, bound, k), k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        parts.append(stored(kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk"))
        if rows.num_rows < block:
            break
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every embedding whose vec_id is divisible by 50."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, table.where("vec_id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
