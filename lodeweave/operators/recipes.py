"""Recipes that shape a found table before it is joined (R-01, R-02, S-21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import profile

#: Columns that a pivot may have: a table of more is no table for people or plans.
MOST = 10_000


def means(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """R-01: the mean of each number column (or of those given) for each group; groups of nulls are groups."""
    names = columns if columns is not None else [c for c in profile.numeric_columns(df) if c not in by]
    return df.groupBy(*by).agg(*(F.round(F.avg(F.col(f"`{c}`")), digits).alias(c) for c in names))


def pivoted_means(df: DataFrame, by: Sequence[str], category: str, value: str, categories: Sequence | None = None, digits: int = 6) -> DataFrame:
    """R-02: a column of means for each category, in their order; where none are given all are found, and more than MOST raise ValueError. Rows without a category go."""
    if categories is None:
        found = df.select(category).where(F.col(category).isNotNull()).distinct().limit(MOST + 1).collect()
        if len(found) > MOST:
            raise ValueError(f"more than {MOST} categories")
        categories = sorted(r[0] for r in found)
    return df.groupBy(*by).pivot(category, list(categories)).agg(F.round(F.avg(value), digits))


def head(df: DataFrame, order: Sequence[str], n: int, columns: Sequence[str] | None = None) -> DataFrame:
    """S-21: the first rows in a stated order, of some columns; each task keeps n rows at most."""
    out = df.orderBy(*order).limit(n)
    return out.select(*columns) if columns else out
