"""How columns are compared: the feature planner (J-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.functions import dates, text
from lodeweave.operators.joins import Feature


def plan(left: DataFrame, right: DataFrame, left_columns: Sequence[Sequence[int]], right_columns: Sequence[Sequence[int]], profile: bool = False) -> list[Feature]:
    """A feature for each pair of column groups, by the left side: one aggregation over its columns.

    Several columns are a date if they read as one, else tokens. One column is a category if its
    rows are at least twice its distinct values; else, if profiled, tokens when half of its frequent tokens
    repeat. Its kind is number, date (every value that is there reads as one) or string.
    """
    if len(left_columns) != len(right_columns) or not left_columns:
        raise ValueError("left and right columns must be as many, and one at least")
    names = [[left.columns[i] for i in g] for g in left_columns]
    theirs = [[right.columns[i] for i in g] for g in right_columns]
    types = {f.name: f.dataType for f in left.schema}
    aggs = [F.count("*").alias("rows")]
    for k, g in enumerate(names):
        joined = F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), 2, "0") if isinstance(types[c], T.IntegralType) and c.lower() != "year" else F.col(c).cast("string") for c in g))
        value = joined if len(g) > 1 else F.col(g[0]).cast("string")
        aggs += [F.count_distinct(value).alias(f"d{k}"), F.count_if(value.isNotNull() & dates.parse_date(value).isNotNull()).alias(f"t{k}"), F.count(value).alias(f"n{k}"), F.count_if(text.is_number(value)).alias(f"f{k}")]
    s = left.agg(*aggs).first()
    out = []
    for k, (g, h) in enumerate(zip(names, theirs)):
        is_date = s[f"n{k}"] > 0 and s[f"t{k}"] == s[f"n{k}"]
        if len(g) > 1:
            kind = "date" if is_date else "token"
        else:
            t = types[g[0]]
            category = s[f"d{k}"] > 0 and s["rows"] // s[f"d{k}"] >= 2
            if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) or (not isinstance(t, T.NumericType) and is_date):
                kind = "date"
            elif isinstance(t, T.NumericType) or (s[f"n{k}"] and s[f"f{k}"] / s[f"n{k}"] >= 0.99):
                kind = "category_number" if category else "number"
            elif category:
                kind = "category"
            else:
                kind = "token" if profile and _repeating(left, g[0]) else "string"
        out.append(Feature(tuple(g), tuple(h), kind))
    return out


def _repeating(df: DataFrame, column: str, top: int = 10) -> bool:
    tokens = df.select(F.explode(text.tokens(F.col(column))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    best = [r["n"] for r in tokens.orderBy(F.desc("n"), "t").limit(top).collect()]
    return bool(best) and sum(n >= 2 for n in best) >= len(best) // 2
