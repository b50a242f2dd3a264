"""Exact quantiles and correlations against whole columns."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import profile, statistics

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def columns(rng, n):
    """Even, heavy-tailed, repeated, nearly constant, with gaps, constant and empty."""
    return [(rng.random(), math.exp(rng.gauss(0, 60)) * rng.choice([-1, 1]), float(rng.choice([1, 1, 1, 2, 5])), 7.0 if rng.random() < 0.999 else rng.random(), rng.gauss(0, 1) if rng.random() < 0.5 else None, 3.0, None) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(len(rows[0]) if rows else 3))).repartition(4)


@pytest.mark.parametrize("n,few,accuracy", [(1, 4096, 10_000), (7, 2, 10_000), (4000, 4096, 10_000), (4000, 3, 40)])
def test_quantiles_are_exact(spark, monkeypatch, n, few, accuracy):
    monkeypatch.setattr(statistics, "FEW", few)
    monkeypatch.setattr(statistics, "ACCURACY", accuracy)
    rows = columns(random.Random(n), n)
    df = frame(spark, rows)
    got = statistics.quantiles(df, df.columns, SHARES)
    for i, c in enumerate(df.columns):
        there = [r[i] for r in rows if r[i] is not None]
        for p in SHARES:
            want = df.agg(F.percentile(c, F.lit(p))).first()[0] if there else None
            assert got[c, p] == want, (c, p)


def test_quantiles_of_odd_values(spark):
    rows = [(float("nan"), float("inf"), 0.0), (1.0, float("-inf"), -0.0), (2.0, 5.0, 0.0), (None, 6.0, None)]
    df = frame(spark, rows)
    got = statistics.quantiles(df, df.columns, (0.0, 0.5, 1.0))
    assert (got["c0", 0.0], got["c0", 0.5]) == (1.0, 2.0) and math.isnan(got["c0", 1.0])
    assert (got["c1", 0.0], got["c1", 0.5], got["c1", 1.0]) == (float("-inf"), 5.5, float("inf")) and got["c2", 0.5] == 0.0
    assert set(statistics.quantiles(frame(spark, []), ["c0"], (0.5,)).values()) == {None}


@pytest.mark.parametrize("method", ["pearson", "spearman", "spearman moved"])
def test_correlations(spark, method):
    rng = random.Random(9)
    rows = []
    for _ in range(500):
        a = rng.gauss(1e6, 3)
        rows.append((a, a + rng.gauss(0, 2) if rng.random() < 0.8 else None, float(rng.randrange(4)), 0.1, -(a**3), rng.choice([None, 1.0, 2.0])))
    df, d = frame(spark, rows), len(rows[0])
    run = {"pearson": profile.pearson, "spearman": profile.spearman, "spearman moved": lambda x: statistics.spearman(x, x.columns, held=0)}[method]
    got = {r.column: r for r in run(df).collect()}
    p = pd.DataFrame(rows, columns=df.columns).astype(float)
    x = p if method == "pearson" else p.rank()
    for i, c in enumerate(df.columns):
        rs = []
        for other in df.columns:
            both = x[[c, other]].dropna() if c != other else pd.concat([x[c].dropna()] * 2, axis=1)
            u, v = both.iloc[:, 0].to_numpy(), both.iloc[:, 1].to_numpy()
            if np.ptp(u) > 0 and np.ptp(v) > 0:
                rs.append(np.corrcoef(u, v)[0, 1])
        if not rs:
            assert got[c].min is None
            continue
        assert [got[c].min, got[c].max, got[c]["mean"], got[c].median, got[c].std] == pytest.approx([min(rs), max(rs), np.mean(rs), np.median(rs), np.std(rs, ddof=1)], abs=1e-7)


def test_correlation_plan_is_linear_in_columns(spark):
    wide = spark.range(50).select(*((F.col("id") * k % 17).cast("double").alias(f"c{k}") for k in range(1, 41)))
    out = profile.pearson(wide)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000 and out.count() == 40
