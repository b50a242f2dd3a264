"""Exact order statistics and co-moments of number columns, without a task that holds a column's values (F-11, F-20, F-21)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.session import shared_path, ship

#: The sketch's accuracy: its ranks are off by 1 / ACCURACY of the values at most.
ACCURACY = 10_000
#: Values of a range that are sorted at last.
FEW = 4096
#: Distinct (column, value) pairs whose ranks every task may hold: 16 MB.
HELD = 1_000_000
#: Cells of a column's values in which they are ranked.
CELLS = 64
_FLAT = 1e-13


@dataclass
class _Sought:
    """The values of ranks k0 and k1 (from 0) of a column, known to lie from low to high."""

    column: str
    position: float
    low: float
    high: float
    below: int = 0
    at_low: int = 0
    inner: int = 0
    margin: float = 2 / ACCURACY
    values: tuple[float, float] | None = None

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)

    def result(self) -> float:
        a, b = self.values
        k0, k1 = self.ranks
        return a if k0 == k1 or a == b else (k1 - self.position) * a + (self.position - k0) * b


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[tuple[str, float], float | None]:
    """Exact interpolated quantiles of number columns by distributed selection, as ``percentile`` gives them; None without values.

    A sketch bounds each rank's value from both sides; a pass counts what lies below, at and between the bounds. While
    the values between are more than FEW, they alone are sketched again; then they are grouped by value and added up.
    Ranges shrink to a few parts in ACCURACY a round whatever the distribution, and repeated values stand on the bounds and end the search.
    """
    def value(c: str) -> Column:
        return F.col(f"`{c}`").cast("double")

    def sketch(x: Column, of: Sequence[float]) -> Column:
        return F.percentile_approx(x, F.array(*(F.lit(min(1.0, max(0.0, p))) for p in of)), F.lit(ACCURACY))

    margin = 2 / ACCURACY
    first = df.agg(*(e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in (("n", F.count(value(c))), ("least", F.min(value(c))), ("most", F.max(value(c))), ("q", sketch(value(c), [s for p in shares for s in (p - margin, p + margin)]))))).first()
    sought, ends = {}, {}
    for i, c in enumerate(columns):
        ends[c] = (first[f"least{i}"], first[f"most{i}"])
        for j, p in enumerate(shares):
            if first[f"n{i}"]:
                low, high = first[f"q{i}"][2 * j : 2 * j + 2]
                sought[c, p] = _Sought(c, p * (first[f"n{i}"] - 1), ends[c][0] if p <= margin else low, ends[c][1] if p >= 1 - margin else high)
    open_ = [s for s in sought.values()]
    while open_:
        exprs = []
        for i, s in enumerate(open_):
            v = value(s.column)
            between = (v > s.low) & (v < s.high)
            exprs += [e.alias(f"{k}{i}") for k, e in (("below", F.count_if(v < s.low)), ("low", F.count_if(v == s.low)), ("inner", F.count_if(between)), ("high", F.count_if(v == s.high)), ("least", F.min(F.when(between, v))), ("most", F.max(F.when(between, v))))]
        row, reset, narrow, few = df.agg(*exprs).first(), [], [], []
        for i, s in enumerate(open_):
            s.below, s.at_low, s.inner, at_high = (row[f"{k}{i}"] for k in ("below", "low", "inner", "high"))
            (k0, k1), single = s.ranks, s.low == s.high
            top = s.below + s.at_low + s.inner
            if k0 < s.below or k1 >= top + (0 if single else at_high):  # the sketch was off: from the column's ends, with a wider margin
                (s.low, s.high), s.margin = ends[s.column], 2 * s.margin
                reset.append(s)
                continue
            known = [s.low if k < s.below + s.at_low else s.high if k >= top else row[f"least{i}"] if k == s.below + s.at_low else row[f"most{i}"] if k == top - 1 else None for k in (k0, k1)]
            if None not in known:
                s.values = tuple(known)
            else:
                (few if s.inner <= FEW or s.margin > 0.2 else narrow).append(s)
        if few:
            for s, found in zip(few, _of_few(df, few, value)):
                s.values = found
        if narrow:
            exprs = []
            for i, s in enumerate(narrow):
                v, start = value(s.column), s.below + s.at_low
                exprs.append(sketch(F.when((v > s.low) & (v < s.high), v), [(s.ranks[0] - start) / s.inner - s.margin, (s.ranks[1] - start + 1) / s.inner + s.margin]).alias(f"q{i}"))
            row = df.agg(*exprs).first()
            for i, s in enumerate(narrow):
                low, high = row[f"q{i}"]
                start = s.below + s.at_low
                if (s.ranks[0] - start) / s.inner > s.margin:
                    s.low = low
                if (s.ranks[1] - start + 1) / s.inner < 1 - s.margin:
                    s.high = high
        open_ = reset + narrow
    return {(c, p): sought[c, p].result() if (c, p) in sought else None for c in columns for p in shares}


def _of_few(df: DataFrame, sought: list[_Sought], value) -> list[tuple[float, float]]:
    """The sought values of ranges with at most FEW values between their bounds."""
    cells = F.array(*(F.when((value(s.column) > s.low) & (value(s.column) < s.high), F.struct(F.lit(i).alias("i"), value(s.column).alias("v"))) for i, s in enumerate(sought)))
    counted = df.select(F.explode(F.array_compact(cells)).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))  # FEW rows for each i
    rank = lambda j: F.element_at(F.array(*(F.lit(s.ranks[j] - s.below - s.at_low) for s in sought)), F.col("i") + 1)
    rows = upto.groupBy("i").agg(F.min(F.when(F.col("upto") > rank(0), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > rank(1), F.col("v"))).alias("b")).collect()
    found = {r["i"]: r for r in rows}
    out = []
    for i, s in enumerate(sought):
        start, end = s.below + s.at_low, s.below + s.at_low + s.inner
        out.append(tuple(s.low if k < start else s.high if k >= end else v for k, v in zip(s.ranks, (found[i]["a"], found[i]["b"]))))
    return out


class _Moments:
    """For each pair of columns, over the rows that have both: their number, sums, sums of squares and of products; pickled to the executors.

    ``ranks``: broadcast, for each column its sorted values and their ranks, which then stand for them.
    """

    def __init__(self, centre: list[float], ranks: Broadcast | None = None):
        self.centre, self.ranks = np.array(centre), ranks

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, ranks = len(self.centre), None if self.ranks is None else self.ranks.value
        n, s, q, p = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            there, x = np.zeros((batch.num_rows, d)), np.zeros((batch.num_rows, d))
            for i, column in enumerate(batch.columns):
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                v = column.to_numpy(zero_copy_only=False).astype(np.float64)
                if ranks is not None:
                    known, rank = ranks[i]
                    v = rank[np.minimum(np.searchsorted(known, v), len(rank) - 1)] if len(rank) else v
                there[:, i], x[:, i] = valid, np.where(valid, v - self.centre[i], 0.0)
            n += there.T @ there
            s += x.T @ there
            q += (x * x).T @ there
            p += x.T @ x
        i, j = (a.ravel().astype(np.int32) for a in np.indices((d, d)))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i, j, n.ravel(), s.ravel(), s.T.ravel(), q.ravel(), q.T.ravel(), p.ravel())], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])


def _correlations(values: DataFrame, names: Sequence[str], moments: _Moments) -> DataFrame:
    """min, max, mean, median and std of each column's correlations with every column, itself included; each pair over the rows that have both.

    A task hands over a row for each pair; a spread within rounding of nothing makes no correlation.
    """
    ship(values.sparkSession)
    sums = values.mapInArrow(moments, "i int, j int, n double, x double, y double, xx double, yy double, xy double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    mean = lambda c: F.col(c) / F.col("n")
    spread = lambda a, aa: mean(aa) - mean(a) * mean(a)
    there = (F.col("n") > 0) & (spread("x", "xx") > _FLAT * mean("xx")) & (spread("y", "yy") > _FLAT * mean("yy"))
    r = F.when(there, (mean("xy") - mean("x") * mean("y")) / (F.sqrt(spread("x", "xx")) * F.sqrt(spread("y", "yy"))))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return sums.select(name.alias("column"), r.alias("r")).groupBy("column").agg(F.min("r").alias("min"), F.max("r").alias("max"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"), F.stddev_samp("r").alias("std"))


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F-20: two passes, the first for the means about which is summed; plan and passes don't grow with the pairs."""
    values = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    centre = values.agg(*(F.avg(c) for c in values.columns)).first()
    return _correlations(values, columns, _Moments([x or 0.0 for x in centre]))


def average_ranks(values: DataFrame) -> DataFrame:
    """(i, v, rank) of the distinct values of each column, i its position: the mean of the ranks that its rows take.

    Values are counted map-side. A column's distinct values lie in cells cut at approximate quantiles, cells are added up and only a
    cell is sorted.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(values.columns))))
    counted = values.select(cells.alias("x")).where("x.v is not null").groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    path = shared_path(values.sparkSession, "counted")
    counted.write.parquet(path)
    counted = values.sparkSession.read.parquet(path)
    edges = counted.groupBy("i").agg(F.percentile_approx("v", F.array(*(F.lit(k / CELLS) for k in range(1, CELLS))), F.lit(ACCURACY)).alias("e"))  # a row for each column
    dealt = counted.join(F.broadcast(edges), "i").withColumn("cell", F.size(F.filter("e", lambda b: b < F.col("v")))).drop("e")
    sums = dealt.groupBy("i", "cell").agg(F.sum("n").alias("s"))
    ahead = sums.select("i", "cell", F.coalesce(F.sum("s").over(Window.partitionBy("i").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # CELLS rows for each column
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("i", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("inside", inside).join(F.broadcast(ahead), ["i", "cell"]).select("i", "v", (F.col("ahead") + F.col("inside") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, columns: Sequence[str], held: int = HELD) -> DataFrame:
    """F-21: as Pearson's over average ranks.

    Where the columns have few distinct values, tasks hold their ranks and the table isn't moved. Else the table's cells are moved once, to
    their ranks, and back into rows; cells of one value are split by adaptive execution.
    """
    d = len(columns)
    values = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    path = shared_path(df.sparkSession, "ranks")
    average_ranks(values).write.parquet(path)
    ranks = df.sparkSession.read.parquet(path)
    rows = values.agg(*(F.count(c) for c in values.columns)).first()
    middle = [(n + 1) / 2 for n in rows]
    if ranks.count() <= held:
        table = ranks.orderBy("i", "v").toArrow()
        i, v, rank = (table.column(c).to_numpy() for c in ("i", "v", "rank"))
        shared = df.sparkSession.sparkContext.broadcast([(v[i == k], rank[i == k]) for k in range(d)])
        return _correlations(values, columns, _Moments(middle, shared))
    cells = values.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(F.array(*(F.struct(F.lit(k).alias("i"), F.col(f"c{k}").alias("v")) for k in range(d)))).alias("x")).select("row", "x.*")
    ranked = cells.join(ranks, ["i", "v"]).groupBy("row").agg(*(F.max(F.when(F.col("i") == k, F.col("rank"))).alias(f"c{k}") for k in range(d))).drop("row")
    return _correlations(ranked, columns, _Moments(middle))
