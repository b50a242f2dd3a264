"""Profiling a table: one aggregation for all scalar features of all columns, one for all token features.

Features of numbers run over numeric columns, features of texts over string columns. Nothing is
collected but one row of aggregates; token features are grouped by (column, token), so a wide table is
still one shuffle. Results are long: a row for each column (or column and token).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.functions import dates, grams, text
from lodeweave.operators import statistics

TOP = 10
SIGMA = 3
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, per_column: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation over ``df``; a row for each column with its features."""
    names = list(next(iter(per_column.values())))
    wide = df.agg(*(c.alias(f"{i}_{k}") for i, fs in enumerate(per_column.values()) for k, c in fs.items()))
    rows = [F.struct(F.lit(col).alias("column"), *(F.col(f"{i}_{k}").alias(k) for k in names)) for i, col in enumerate(per_column)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of)


def _by_value(df: DataFrame, columns: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """A row for each column with aggregates over its distinct texts: ``value`` (null where missing) and ``n``, how many rows have it.

    One grouping by (column, value), summed map-side, so that a value is examined once however often it occurs.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    counted = df.select(cells.alias("x")).groupBy(F.col("x.column").alias("column"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))
    found = counted.groupBy("column").agg(*(a.alias(k) for k, a in aggregates.items()))
    return every.join(F.broadcast(found), "column", "left")  # a row for each column


def missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-01: number and ratio of nulls, of all rows."""
    def one(c: str) -> dict[str, Column]:
        n = F.count_if(F.col(c).isNull())
        return {"number_of_missing_values": n, "ratio_of_missing_values": _ratio(n, F.count("*"))}

    return _long(df, {c: one(c) for c in columns or df.columns})


def distinct(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """F-02, P-09: number and ratio of distinct values, and whether the column is categorical (ratio below 0.2).

    Exact counts of several columns are made by grouping (column, value) pairs once; with ``exact``
    false HyperLogLog sketches make it one map-side aggregation.
    """
    names = list(columns or df.columns)
    if not exact:
        out = _long(df, {c: {"number_of_distinct_values": F.approx_count_distinct(c), "n": F.count("*")} for c in names})
    else:
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names)))
        counted = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("k"))
        out = counted.groupBy("column").agg(F.count("value").alias("number_of_distinct_values"), F.sum("k").alias("n"))
    ratio = _ratio(F.col("number_of_distinct_values"), F.col("n"))
    return out.select("column", "number_of_distinct_values", ratio.alias("ratio_of_distinct_values"), F.coalesce(ratio < 0.2, F.lit(False)).alias("categorical"))


def spaces(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-03: leading and trailing blanks; an empty or null cell counts as trailing."""
    def one(c: str) -> dict[str, Column]:
        v = F.coalesce(F.col(c), F.lit(""))
        lead, trail = F.count_if(v.rlike(r"^\s+")), F.count_if(v.rlike(r"\s+$") | (v == ""))
        return {"number_of_leading_spaces": lead, "ratio_of_leading_spaces": _ratio(lead, F.count("*")), "number_of_trailing_spaces": trail, "ratio_of_trailing_spaces": _ratio(trail, F.count("*"))}

    return _long(df, {c: one(c) for c in columns or string_columns(df)})


def trimmed(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-03: the table as later features see it: texts without outer white space, nothing but white space as missing."""
    names = set(columns if columns is not None else string_columns(df))
    cut = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", "")
    return df.select(*(F.when(F.col(f"`{c}`").rlike(r"^\s+$"), None).otherwise(cut(c)).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


def numeric_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-08, F-19: values that are numbers, and values with a digit."""
    def one(c: str) -> dict[str, Column]:
        v = F.col(c).cast("string")
        n, d = F.count_if(text.is_number(v)), F.count_if(v.rlike("[0-9]"))
        return {"number_of_numeric_values": n, "ratio_of_numeric_values": _ratio(n, F.count(c)), "number_of_values_containing_numeric_char": F.nullif(d, F.lit(0)), "ratio_of_values_containing_numeric_char": F.nullif(_ratio(d, F.count(c)), F.lit(0.0))}

    return _long(df, {c: one(c) for c in columns or df.columns})


def signs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-10: positive, negative, 0, 1 and -1 values."""
    def one(c: str) -> dict[str, Column]:
        v = F.col(c)
        return {"positive": F.count_if(v > 0), "negative": F.count_if(v < 0), "zero": F.count_if(v == 0), "one": F.count_if(v == 1), "minus_one": F.count_if(v == -1)}

    return _long(df, {c: one(c) for c in columns or numeric_columns(df)})


def targets(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-11: mean, standard deviation, median and quartiles (interpolated) of numbers; quartiles by distributed selection."""
    names = list(columns or numeric_columns(df))
    found = statistics.quantiles(df, names, (0.25, 0.5, 0.75))

    def one(c: str) -> dict[str, Column]:
        q = {k: F.lit(found[c, p]).cast("double") for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
        return {"mean": F.avg(c), "std": F.coalesce(F.stddev_samp(c), F.lit(0.0)), **q}

    return _long(df, {c: one(c) for c in names})


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-09: values more than three sample deviations from the mean; two passes, the first's one row broadcast."""
    names = list(columns or numeric_columns(df))
    stats = df.agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    joined = df.select(*names).join(F.broadcast(stats))
    return _long(joined, {c: {"number_of_outlier_numeric_values": F.count_if(F.abs(F.col(c) - F.col(f"m_{i}")) > SIGMA * F.col(f"s_{i}"))} for i, c in enumerate(names)})


def _tokens(df: DataFrame, columns: Sequence[str], split) -> DataFrame:
    """(column, token) of every token of every column: one pass over the table."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns)))
    return df.select(cells.alias("x")).select("x.column", F.explode(split(F.col("x.v"))).alias("token"))


def _split(by: str):
    return {"space": text.tokens, "punctuation": text.pieces, "value": lambda v: F.array_compact(F.array(v)), "word": text.analyzed}[by]


def top_tokens(df: DataFrame, columns: Sequence[str] | None = None, by: str = "space", only: str | None = None, k: int = TOP) -> DataFrame:
    """F-12 to F-15, F-17, F-22: the k most frequent tokens of each column, ties by token.

    by: "space", "punctuation", "value" (whole values) or "word"; only: "numeric" or "alphanumeric".
    """
    found = _tokens(df, columns or string_columns(df), _split(by))
    if only == "numeric":
        found = found.where(text.is_number(F.col("token")))
    elif only == "alphanumeric":
        found = found.where(F.col("token").rlike(r"^[\p{L}\p{N}]+$"))
    counted = found.groupBy("column", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "token"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def token_numbers(df: DataFrame, columns: Sequence[str] | None = None, by: str = "space") -> DataFrame:
    """F-04, F-16, F-17: numbers of tokens, of distinct ones and of those with a digit, and their ratios."""
    counted = _tokens(df, columns or string_columns(df), _split(by)).groupBy("column", "token").agg(F.count("*").alias("n"))
    digit = F.nullif(F.sum(F.when(F.col("token").rlike("[0-9]"), F.col("n")).otherwise(0)), F.lit(0))
    out = counted.groupBy("column").agg(F.sum("n").alias("number_of_tokens"), F.count("*").alias("number_of_distinct_tokens"), digit.alias("number_of_tokens_containing_numeric_char"))
    return out.select("*", (F.col("number_of_distinct_tokens") / F.col("number_of_tokens")).alias("ratio_of_distinct_tokens"), (F.col("number_of_tokens_containing_numeric_char") / F.col("number_of_tokens")).alias("ratio_of_tokens_containing_numeric_char"))


def digit_density(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-18: digits over characters of a whole column."""
    def one(c: str) -> dict[str, Column]:
        v = F.col(c)
        return {"numeric_char_density": _ratio(F.sum(F.length(v) - F.length(F.regexp_replace(v, "[0-9]", ""))), F.sum(F.length(v)))}

    return _long(df, {c: one(c) for c in columns or string_columns(df)})


def filenames(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-06: values that begin like a file's name."""
    return _long(df, {c: {"num_filename": F.count_if(F.col(c).rlike(r"^\w+\.[a-z]{1,5}"))} for c in columns or string_columns(df)})


def punctuation(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """F-07: the most frequent punctuation marks: count, ratio to characters, mean density of cells, and cells whose density is an outlier.

    Numeric cells count as without punctuation. A cell is reduced to its marks and its length once; both passes (all
    marks' sums and deviations in one row, then outliers) count in that short text.
    """
    v = F.coalesce(F.col(column).cast("string"), F.lit(""))
    marks = [m for m in PUNCTUATION]
    other = "[^" + "".join("\\" + m for m in marks) + "]+"
    cell = df.select(F.when(text.is_number(v), "").otherwise(F.regexp_replace(v, other, "")).alias("v"), F.length(v).alias("chars"))
    many = {m: F.length("v") - F.length(F.replace(F.col("v"), F.lit(m), F.lit(""))) for m in marks}
    density = {m: F.coalesce(_ratio(many[m], F.col("chars")), F.lit(0.0)) for m in marks}
    stats = cell.agg(F.sum("chars").alias("all"), *(f.alias(f"{k_}{i}") for i, m in enumerate(marks) for k_, f in (("n", F.sum(many[m])), ("d", F.avg(density[m])), ("s", F.stddev_pop(density[m])))))
    outs = cell.join(F.broadcast(stats)).agg(F.first("all").alias("all"), *(x for i, m in enumerate(marks) for x in (F.first(f"n{i}").alias(f"n{i}"), F.first(f"d{i}").alias(f"d{i}"), F.count_if(F.abs(density[m] - F.col(f"d{i}")) > SIGMA * F.col(f"s{i}")).alias(f"o{i}"))))
    rows = [F.struct(F.lit(m).alias("punctuation"), F.col(f"n{i}").alias("count"), _ratio(F.col(f"n{i}"), F.col("all")).alias("ratio"), F.col(f"d{i}").alias("density_of_cell"), F.col(f"o{i}").alias("num_outlier_cells")) for i, m in enumerate(marks)]
    return outs.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("count") > 0).orderBy(F.desc("count"), "punctuation").limit(k)


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-20: min, max, mean, median and std of each column's correlations with every column, itself included."""
    return statistics.pearson(df, list(columns or numeric_columns(df)))


def spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-21: as Pearson's over average ranks."""
    return statistics.spearman(df, list(columns or numeric_columns(df)))


def language(df: DataFrame, column: str) -> DataFrame:
    """F-05: languages of a column's cells by their share of frequent words, numeric cells skipped; most frequent first."""
    stop = {
        "en": "the and of to in is that for with was are this by be at from or".split(),
        "fr": "le la les des et un une du que qui dans pour est avec sur par".split(),
        "de": "der die das und ist nicht ein eine mit von zu den im auf für des".split(),
        "es": "el la los las de que y en un una por con para es se del".split(),
    }
    w = text.analyzed(F.col(column))
    best = F.array_max(F.array(*(F.struct(F.size(F.array_intersect(w, F.array(*map(F.lit, s)))).alias("n"), F.lit(k).alias("language")) for k, s in stop.items())))
    cells = df.where(F.col(column).isNotNull() & ~text.is_number(F.col(column))).select(best.alias("b")).where("b.n > 0")
    return cells.groupBy(F.col("b.language").alias("language")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "language")


def language_profiles(df: DataFrame, column: str, language: str, k: int = 300) -> DataFrame:
    """F-05: (language, gram, rank): the k runs of three letters that most cells of a language have, ties by run, learnt from labelled cells."""
    cells = df.where(F.col(language).isNotNull() & F.col(column).isNotNull())
    counted = grams.counted(cells, column, language).groupBy("language", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select("language", "gram", "rank")


def language_by(df: DataFrame, column: str, profiles: DataFrame, languages: int = 200) -> DataFrame:
    """F-05: as ``language``, by profiles: a cell is of the language of whose frequent runs it has most, of equals the last by name.

    Profiles of at most ``languages`` languages go to every task; more raise ValueError.
    """
    known = {r["language"]: r["grams"] for r in profiles.groupBy("language").agg(F.collect_list("gram").alias("grams")).limit(languages + 1).collect()}
    if len(known) > languages:
        raise ValueError(f"more than {languages} languages")
    cells = df.where(F.col(column).isNotNull() & ~text.is_number(F.col(column)))
    if not known:
        return cells.select(F.lit("").alias("language"), F.lit(0).cast("bigint").alias("count")).limit(0)
    names = sorted(known)
    counted = grams.nearest(cells, column, [known[x] for x in names]).groupBy("at").agg(F.sum("n").alias("count"))
    return counted.select(F.get(F.array(*map(F.lit, names)), F.col("at")).alias("language"), "count").orderBy(F.desc("count"), "language")


def entity_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P-02, P-10: whether each string column holds named entities.

    It does if some value is no date, there is a value, and numeric rows over distinct values are at most a half.
    """
    v = F.col("value")
    many, undated = F.count(v), F.count_if(v.isNotNull() & dates.parse_date(v).isNull())
    numeric = F.coalesce(F.sum(F.when(text.is_number(v), F.col("n"))), F.lit(0))
    found = _by_value(df, columns or string_columns(df), {"n_distinct": many, "undated": undated, "numeric": numeric})
    entity = (F.col("undated") > 0) & (F.col("n_distinct") > 0) & (F.try_divide("numeric", "n_distinct") <= 0.5)
    return found.select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce(entity, F.lit(False)).alias("is_entity"))


def entity_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-01: (column, value): distinct values that aren't null, as texts; rows, not one list, since columns can be large."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(cells.alias("x")).select("x.*").where("value is not null").distinct()


def temporal_coverage(df: DataFrame, columns: Sequence[str], supplied: dict[str, tuple[str | None, str | None]] | None = None) -> DataFrame:
    """P-03, P-04: first and last time of each column; null unless half of all rows are dates; supplied ends win."""
    kinds = dict(df.dtypes)

    def one(c: str) -> dict[str, Column]:
        ts = F.col(c).cast("timestamp") if kinds[c] in ("timestamp", "date", "timestamp_ntz") else dates.parse_date(F.col(c).cast("string"))
        enough = (F.count(ts) > 0) & (F.count(ts) >= F.floor(F.count("*") / 2))
        start, end = (supplied or {}).get(c, (None, None))
        given = [dates.validate_date(F.lit(x).cast("string")) for x in (start, end)]
        return {"start": F.coalesce(F.first(given[0]), F.when(enough, dates.iso(F.min(ts)))), "end": F.coalesce(F.first(given[1]), F.when(enough, dates.iso(F.max(ts))))}

    return _long(df, {c: one(c) for c in columns})


def majority_type(df: DataFrame, columns: Sequence[str], share: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """G-01: the semantic type that ``share`` of a column's values have, else Text; MissingData if as many are missing.

    known (value, type): names of places and people, type Location or Person; cells are compared without case. A column is of the first type that fits of
    Time, Location, Person, Float and Interval.
    """
    v = F.trim("value")
    there = v.isNotNull() & (v != "")
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    kinds = {"Time": dates.parse_date(v).isNotNull(), "Float": text.is_number(v), "Interval": v.rlike(r"^[+-]?[0-9.]+\s*(-|to)\s*[+-]?[0-9.]+$")}
    found = _by_value(df, columns, {"n": F.sum("n"), "n_values": rows(there), **{k: rows(there & cond) for k, cond in kinds.items()}})
    order = list(kinds)
    if known is not None:
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lower(F.trim(F.col(c).cast("string"))).alias("value")) for c in columns)))
        counted = df.select(cells.alias("x")).where("x.value <> ''").groupBy("x.column", "x.value").agg(F.count("*").alias("k"))
        names = known.select(F.lower(F.trim("value")).alias("value"), "type").distinct()
        of = counted.join(names, "value").groupBy("column").agg(*(F.coalesce(F.sum(F.when(F.col("type") == t, F.col("k"))), F.lit(0)).alias(t) for t in ("Location", "Person")))
        found, order = found.join(F.broadcast(of), "column", "left"), ["Time", "Location", "Person", "Float", "Interval"]  # a row for each column
    here = F.coalesce("n_values", F.lit(0))
    kind = F.when(F.coalesce(F.try_divide(F.col("n") - here, "n"), F.lit(1.0)) >= share, "MissingData")
    for k in order:
        kind = kind.when(F.coalesce(F.try_divide(k, here), F.lit(0.0)) >= share, k)
    return found.select("column", kind.otherwise("Text").alias("semantic_type"), here.alias("n_values"))


def summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F-23, its plain figures: valid, invalid and unique values of each column, the commonest one (of equals the first), the Herfindahl index of values; for numbers also mean, std, least, most and median.

    What depends on values comes from one grouping by (column, value).
    """
    names = list(columns or df.columns)
    numbers = [c for c in names if c in numeric_columns(df)]
    there = F.col("value").isNotNull()
    square = F.sum(F.when(there, F.col("n").cast("double") * F.col("n")))
    found = _by_value(df, names, {"valid": F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)), "invalid": F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)), "unique": F.count("value"), "mode": F.min_by(F.when(there, F.col("value")), F.when(there, F.struct(-F.col("n"), "value"))), "square": square})
    found = found.select("column", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("valid", "invalid", "unique")), "mode", F.try_divide("square", F.col("valid").cast("double") * F.col("valid")).alias("herfindahl"))
    if not numbers:
        return found.select("*", *(F.lit(None).cast("double").alias(c) for c in ("mean", "std", "least", "most", "median")))
    middle = statistics.quantiles(df, numbers, (0.5,))
    of = _long(df, {c: {"mean": F.avg(c), "std": F.stddev_samp(c), "least": F.min(c).cast("double"), "most": F.max(c).cast("double"), "median": F.lit(middle[c, 0.5]).cast("double")} for c in numbers})
    return found.join(F.broadcast(of), "column", "left")
