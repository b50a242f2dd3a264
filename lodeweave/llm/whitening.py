"""Whitening of embeddings: covariance by upper-triangle column aggregates, eigenvectors by LAPACK.

Each component c of a vector becomes the whole number floor(scale * c) + shift. One aggregation gives
the exact sums of each dimension; a second one is made of generated SQL, a sum of centred products
for each pair of dimensions, grouped by pairs of tiles of TILE dimensions (the upper triangle of tiles), so that a task hands over
some d * d / 2 numbers, whatever its share of the table. The driver assembles the matrix (d is the vectors' width) and
decomposes it with LAPACK. Rows are then projected in Arrow batches, and the covariance of what comes
out is measured by the same kind of aggregation.

Entries are centred before they are multiplied: by the nearest whole number to the mean in whole
numbers, then by what is left of the mean. deviation, the sum over dimensions of (n * x - S)**2, is exact:
with c = x - r and R = S - n * r, r the mean rounded, it is n*n * sum(c*c) - 2n * sum(c*R) + sum(R*R).

Cases: vectors that are null, or hold a null or non-finite entry, take no part; shorter vectors are
padded with zeros; ids may be null and rows repeated, each row counts; an empty table gives an empty
result. A component whose eigenvalue is below 1e-12 of the largest has no spread: its ``whitened`` is
null and it isn't part of identity_error. Entries of 2**46 or more in magnitude raise ValueError.
Columns other than id and vector are ignored. Of the two signs of an eigenvector the one is taken
whose entry of the largest magnitude is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm._store import arrow

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Magnitude that scaled entries must stay below: floor of a double is exact there.
_MOST = 1 << 52
_LEAST_SHARE = 1e-12
#: Columns of a tile: a task sums TILE * TILE products for each pair of tiles.
TILE = 8
#: A sum is carried in two halves of so many bits, so that no sum of 64 bits overflows.
_HALF = 26


@dataclass
class Whitening:
    """n rows, S = sums of each dimension, eigenvalues from the largest on with their unit vectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float
    shift: int

    def __post_init__(self) -> None:
        self.middle = [round(Fraction(s, self.n)) if self.n else 0 for s in self.sums]
        self.rest = [s - self.n * r for s, r in zip(self.sums, self.middle)]

    @property
    def spread(self) -> np.ndarray:
        """Which components have a spread."""
        return self.values > _LEAST_SHARE * max(self.values.max(initial=0.0), 0.0)


def _vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull()).where(~F.coalesce(bad, F.lit(False)))


def _scaled(df: DataFrame, width: int, scale: float) -> DataFrame:
    """Columns x0, x1, ...: floor(scale * entry), missing entries as zeros."""
    return df.select(*(F.floor(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) * float(scale)).cast("bigint").alias(f"x{i}") for i in range(width)))


def pair_sums(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and the symmetric matrix of summed products of number columns, by one aggregation.

    Columns are taken TILE at a time. A row meets the pairs of tiles i <= j, and a group of the aggregation is such a pair, with a
    generated sum for each of its TILE * TILE products: so a plan of any width is some dozens of expressions, which Spark compiles.
    """
    d, tiles = len(columns), -(-len(columns) // TILE)
    names = [*columns, *["0D"] * (tiles * TILE - d)]
    blocks = ", ".join(f"array({', '.join(names[t * TILE : (t + 1) * TILE])})" for t in range(tiles))
    pairs = ", ".join(f"named_struct('i', {i}, 'j', {j})" for i in range(tiles) for j in range(i, tiles))
    met = df.selectExpr(f"array({blocks}) AS b", f"explode(array({pairs})) AS p").selectExpr("p.i AS i", "p.j AS j", "b[p.i] AS x", "b[p.j] AS y")
    met = met.selectExpr("i", "j", *(f"{v}[{k}] AS {v}{k}" for v in "xy" for k in range(TILE)))
    sums = [f"sum(x{k}) AS s{k}" for k in range(TILE)] + [f"sum(x{k} * y{l}) AS p{k}_{l}" for k in range(TILE) for l in range(TILE)]
    rows = met.groupBy("i", "j").agg(F.count("*").alias("n"), *map(F.expr, sums)).collect()  # a row for each pair of tiles
    n, total, out = 0, np.zeros(tiles * TILE), np.zeros((tiles * TILE, tiles * TILE))
    for r in rows:
        x, y = (slice(r[t] * TILE, (r[t] + 1) * TILE) for t in "ij")
        out[x, y] = np.array(r[3 + TILE :]).reshape(TILE, TILE)
        if r["i"] == r["j"]:
            n, total[x] = r["n"], r[3 : 3 + TILE]
    return n, total[:d], (np.triu(out) + np.triu(out, 1).T)[:d, :d]


def fit(rows: DataFrame, scale: float = SCALE, shift: int = SHIFT) -> Whitening:
    """The whitening of rows (vec_id, v)."""
    n, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x * float(scale)))))).first()
    if (most or 0) >= _MOST:
        raise ValueError(f"entries must be below {_MOST / scale:g} in magnitude")
    if not width:
        return Whitening(n, [], np.empty(0), np.empty((0, 0)), 0.0, scale, shift)
    x = _scaled(rows, width, scale)
    halves = x.selectExpr(*(f"sum(shiftright(x{i}, {_HALF})) AS h{i}" for i in range(width)), *(f"sum(x{i} & {(1 << _HALF) - 1}) AS l{i}" for i in range(width))).first()
    plain = [(halves[i] << _HALF) + halves[width + i] for i in range(width)]
    model = Whitening(n, [s + n * shift for s in plain], np.empty(0), np.empty((0, 0)), 0.0, scale, shift)
    centred = x.selectExpr(*(f"CAST(x{i} - {r - shift}L AS DOUBLE) - {float(Fraction(b, n))!r}D AS y{i}" for i, (r, b) in enumerate(zip(model.middle, model.rest))))
    _, _, products = pair_sums(centred, [f"y{i}" for i in range(width)])
    cov = products / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(width)])
    model.values, model.vectors, model.trace = np.maximum(values, 0.0), vectors * sign, float(np.trace(cov))
    return model


class _Project:
    """Batches (vec_id, v) to (vec_id, deviation, w); pickled to the executors."""

    def __init__(self, model: Whitening, count: int):
        self.model = model
        spread = model.spread[:count]
        with np.errstate(divide="ignore"):
            over = np.where(spread, 1 / np.sqrt(model.values[:count]), 0.0)
        self.matrix, self.spread = model.vectors[:, :count] * over, spread

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = self.model
        d, k = self.matrix.shape
        middle, rest = np.array([r - m.shift for r in m.middle], np.int64), np.array([b / m.n for b in m.rest])
        base = sum(b * b for b in m.rest)
        for batch in batches:
            column, size = batch.column(1), batch.num_rows
            length = np.diff(column.offsets.to_numpy())
            x = np.zeros((size, d))
            x[np.arange(d) < length[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            c = np.floor(m.scale * x).astype(np.int64) - middle
            w = (c - rest) @ self.matrix
            most = int(np.abs(c).max(initial=0))
            exact = d * most * max(most, m.n) < 1 << 62
            whole, left = (c, np.array(m.rest, np.int64)) if exact else (c.astype(object), np.array(m.rest, object))
            square, cross = (whole * whole).sum(axis=1), (whole * left).sum(axis=1)
            deviation = [m.n * m.n * int(a) - 2 * m.n * int(b) + base for a, b in zip(square, cross)]
            deviation = pa.array([Decimal(x) if x < 10**38 else None for x in deviation], pa.decimal128(38, 0))
            flat = pa.array(w.ravel(), mask=np.tile(~self.spread, size))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (size + 1) * k, k, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["vec_id", "deviation", "w"])


def project(rows: DataFrame, model: Whitening, count: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation (decimal(38,0), null beyond), w (the first ``count`` whitened components) of rows (vec_id, v)."""
    count = min(count, len(model.sums))
    return arrow(rows, _Project(model, count), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), w array<double>")


def identity_error(projected: DataFrame, model: Whitening, count: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the components with a spread."""
    which = np.flatnonzero(model.spread[:count])
    if not len(which):
        return None
    n, sums, products = pair_sums(projected.select(*(F.get("w", F.lit(int(i))).alias(f"w{i}") for i in which)), [f"w{i}" for i in which])
    mean = sums / n
    return float(np.abs(products / n - np.outer(mean, mean) - np.eye(len(which))).max())


def whiten(table: DataFrame, count: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = _vectors(table, vec_id, embedding)
    model = fit(rows, scale, shift)
    count = min(count, len(model.sums))
    if not count:  # no vector has an entry
        return table.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    out = project(rows, model, count)
    error = identity_error(out, model, count)
    share: Column = F.array(*(F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.values[:count]))
    made = out.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return made.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every embedding. ``deviation`` is null where 64 bits don't hold it, ``deviation_exact`` has it in 38 digits."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    exact = F.col("deviation")
    return out.select("vec_id", "component", "n", exact.try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error", exact.alias("deviation_exact"))
