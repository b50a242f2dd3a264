"""Similarities of two values, from 0 to 1, as column expressions (M-01 to M-07)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(left: Column, right: Column) -> Column:
    return F.coalesce((left == right).cast("double"), F.lit(0.0))


def equal_ignoring_case(left: Column, right: Column) -> Column:
    return equal(F.lower(left), F.lower(right))


def token_set(tokens: Column) -> Column:
    """A token array's distinct members, case ignored."""
    return F.array_distinct(F.transform(tokens, lambda t: F.lower(t)))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays of tokens, case ignored; two empty ones have nothing in common."""
    a, b = token_set(left), token_set(right)
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.when(union > 0, F.size(F.array_intersect(a, b)) / union), F.lit(0.0))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two token sets."""
    a, b = token_set(left), token_set(right)
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b))), F.lit(0.0))


def levenshtein(left: Column, right: Column) -> Column:
    """One less the edit distance over the longer length; case counts."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.coalesce(F.when(longest > 0, 1 - F.levenshtein(left, right) / longest).otherwise(1.0), F.lit(0.0))


def numeric(left: Column, right: Column, span: Column) -> Column:
    """Root of one less the difference over the left column's range, never below 0."""
    return F.coalesce(F.when(span > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - F.abs(left - right) / span))).otherwise((left == right).cast("double")), F.lit(0.0))


def temporal(left: Column, right: Column, span: Column) -> Column:
    """One less the seconds between two times over the left column's range; may be negative."""
    return F.coalesce(F.when(span > 0, 1 - F.abs(left - right) / span), F.lit(0.0))


def ngrams(text: Column, n: int = 2) -> Column:
    size = F.length(text)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.lower(text), i, n)))).otherwise(F.array(F.lower(text)))


def ngram(left: Column, right: Column, n: int = 2) -> Column:
    """Jaccard similarity of character n-grams."""
    return jaccard(ngrams(left, n), ngrams(right, n))


def hybrid_jaccard(left: Column, right: Column, least: float = 0.5) -> Column:
    """Jaccard of token arrays where tokens also match by edit similarity: each left token's best similarity of ``least`` or more counts."""
    a, b = token_set(left), token_set(right)
    best = F.transform(a, lambda x: F.coalesce(F.array_max(F.transform(b, lambda y: levenshtein(x, y))), F.lit(0.0)))
    good = F.filter(best, lambda s: s >= least)
    total = F.aggregate(good, F.lit(0.0), lambda acc, s: acc + s)
    return F.coalesce(F.when(F.size(a) + F.size(b) > 0, total / F.greatest(F.size(a) + F.size(b) - F.size(good), F.lit(1))), F.lit(0.0))


def jaro_winkler(left: Column, right: Column) -> Column:
    """Jaro-Winkler similarity, for each Arrow batch in Python: Spark has no such function."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None:
                return 0.0
            if s == t:
                return 1.0
            reach = max(max(len(s), len(t)) // 2 - 1, 0)
            used, matched = [False] * len(t), []
            for i, c in enumerate(s):
                for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
                    if not used[j] and t[j] == c:
                        used[j] = True
                        matched.append(c)
                        break
            m = len(matched)
            if not m:
                return 0.0
            half = sum(x != y for x, y in zip(matched, (c for c, u in zip(t, used) if u))) / 2
            jaro = (m / len(s) + m / len(t) + (m - half) / m) / 3
            prefix = 0
            for x, y in zip(s[:4], t[:4]):
                if x != y:
                    break
                prefix += 1
            return jaro + prefix * 0.1 * (1 - jaro)

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return run(left, right)
