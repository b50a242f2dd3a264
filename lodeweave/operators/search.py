"""Search predicates over a catalog (Q-01 to Q-14), as DataFrame operations.

Terms meet entity values through an inverted index: a term is looked up by its first word, then
checked as a phrase; there is no comparison of all terms with all values.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import dates, text
from lodeweave.operators import index as stored

TERMS = 1000
RATIO = 0.5
K1, B = 1.2, 0.75


def variables(catalog: DataFrame) -> DataFrame:
    """A row for each variable: dataset_id, offset, v."""
    return catalog.select("dataset_id", F.posexplode("variables").alias("offset", "v"))


def postings(catalog: DataFrame) -> DataFrame:
    """(token, dataset_id, offset, value, padded): entity values by each of their words."""
    values = variables(catalog).select("dataset_id", "offset", F.explode("v.named_entity").alias("value"))
    rows = values.select("dataset_id", "offset", "value", text.padded(F.col("value")).alias("padded"), F.explode(F.array_distinct(text.analyzed(F.col("value")))).alias("token"))
    return rows.select("token", "dataset_id", "offset", "value", "padded")


def needed(n: int, ratio: float | None = RATIO) -> int:
    """How many of n terms must match."""
    return math.ceil((ratio or RATIO) * n)


def terms_hits(index: DataFrame, terms: DataFrame, ratio: float | None = RATIO, limit: int = TERMS, by: Sequence[str] = ()) -> DataFrame:
    """Q-01, Q-02: (by.., dataset_id, offset, n_terms, terms, values) of variables that hold enough of the terms.

    terms (by.., term): distinct texts, in order of the text; the first ``limit`` are asked, all count
    towards the number that must match up to that limit. ``by`` columns part several questions.
    """
    on = ["token", "bucket"] if "bucket" in index.columns else ["token"]
    distinct = terms.where("term is not null").select(*by, F.lower("term").alias("term")).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy("term")) if by else F.row_number().over(Window.orderBy("term"))
    asked = distinct.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n") if by else distinct.orderBy("term").limit(limit)
    size = asked.groupBy(*by).agg(F.ceil(F.count("*") * (ratio or RATIO)).alias("_need"))
    keyed = asked.select(*by, "term", text.padded(F.col("term")).alias("_p"), F.get(text.analyzed(F.col("term")), F.lit(0)).alias("token")).where(F.length("token") > 0)
    if "bucket" in on:  # a stored index: only the asked tokens' folders are read
        keyed = keyed.withColumn("bucket", stored.bucket_of(F.col("token")))
    found = index.join(keyed if by else F.broadcast(keyed), on).where(F.contains("padded", F.col("_p")))
    hits = found.groupBy(*by, "dataset_id", "offset").agg(F.count_distinct("term").alias("n_terms"), F.array_sort(F.collect_set("term")).alias("terms"), F.array_sort(F.collect_set("value")).alias("values"))
    joined = hits.join(F.broadcast(size), list(by)) if by else hits.join(F.broadcast(size))
    return joined.where(F.col("n_terms") >= F.col("_need")).drop("_need")


def phrase_hits(index: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """(dataset_id, offset) of variables of which a value holds one of the phrases."""
    terms = index.sparkSession.createDataFrame([(p,) for p in phrases] or [(None,)], "term string")
    return terms_hits(index, terms, 1e-9, len(phrases) or 1).select("dataset_id", "offset")


def covers(v: Column, start: str | None, end: str | None) -> Column:
    """Q-04: whether a variable's coverage begins no later than start and ends no earlier than end; ends that aren't dates ask nothing."""
    s, e = (dates.parse_date(F.lit(x).cast("string")) for x in (start, end))
    return (s.isNull() | F.coalesce(dates.parse_date(v["temporal_coverage"]["start"]) <= s, F.lit(False))) & (e.isNull() | F.coalesce(dates.parse_date(v["temporal_coverage"]["end"]) >= e, F.lit(False)))


def temporal(start: str | None, end: str | None) -> Column:
    return F.exists("variables", lambda v: covers(v, start, end))


def by_id(dataset_id: int) -> Column:
    return F.col("dataset_id") == dataset_id


def by_variable_id(variable_id: int) -> Column:
    return F.exists("variables", lambda v: v["dataset_id"] == variable_id)


def _field(value: Column, wanted: Column, is_list: bool, phrase: bool) -> Column:
    test = (lambda x: text.has_phrase(x, wanted)) if phrase else (lambda x: text.has_any(x, wanted))
    return F.coalesce(F.exists(value, test) if is_list else test(value), F.lit(False))


_LISTS = {"keywords", "variables.semantic_type", "variables.named_entity"}


def key_values(pairs: Sequence[tuple[str, object]], disjunctive: bool = False, phrase: bool = True) -> Column:
    """Q-06: all pairs hold; a list of values means all of them, or any if ``disjunctive``; pairs on ``variables.`` hold on one variable."""
    def one(value_of, key: str, wanted: object) -> Column:
        many = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        exact = phrase or key == "variables.named_entity"
        tests = [_field(value_of(key), F.lit(str(w)), key in _LISTS, exact) for w in many]
        out = tests[0]
        for t in tests[1:]:
            out = (out | t) if disjunctive else (out & t)
        return out

    whole = F.lit(True)
    for k, w in pairs:
        if not k.startswith("variables."):
            whole = whole & one(F.col, k, w)
    nested = [(k, w) for k, w in pairs if k.startswith("variables.")]
    if nested:
        def on(v: Column) -> Column:
            out = F.lit(True)
            for k, w in nested:
                out = out & one(lambda key: v[key.removeprefix("variables.")], k, w)
            return out

        whole = whole & F.coalesce(F.exists("variables", on), F.lit(False))
    return whole


def url_is(url: str) -> Column:
    """Q-07."""
    a = F.col("materialization.arguments")
    return F.coalesce(F.col("url") == url, F.lit(False)) | F.coalesce(a["url"] == url, F.lit(False)) | F.coalesce(a["uri"] == url, F.lit(False))


def document_text() -> Column:
    """All texts of a description, its variables' included, equally weighted."""
    join = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), " ")
    of_variable = F.transform("variables", lambda v: F.concat_ws(" ", v["name"], v["description"], join(v["semantic_type"]), join(v["named_entity"])))
    return F.concat_ws(" ", "title", "description", "url", join(F.col("keywords")), join(of_variable))


def any_field(query: str) -> Column:
    """Q-08."""
    return F.coalesce(text.has_any(document_text(), F.lit(query)), F.lit(False))


def all_of(*conditions: Column | None) -> Column:
    """Q-10, conjunction; missing parts are left out."""
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & c
    return out


def any_of(*conditions: Column | None) -> Column:
    """Q-10, disjunction of at least one; without parts everything matches."""
    here = [c for c in conditions if c is not None]
    out = here[0] if here else F.lit(True)
    for c in here[1:]:
        out = out | c
    return out


def bm25(corpus: DataFrame, query: str, key: str, column: str, k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """Q-14: (key, score) by Okapi BM25, ties by key, the k best.

    Only the query's words are counted: one pass makes a row of each matching text, whose word counts and
    length are all that is shuffled; frequencies and the mean length are one aggregation.
    """
    words = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    tokens = corpus.select(key, text.analyzed(F.coalesce(F.col(column), F.lit(""))).alias("t"))
    counted = tokens.select(key, F.size("t").alias("len"), *((F.size("t") - F.size(F.array_remove("t", w))).alias(f"n{i}") for i, w in enumerate(words)))
    stats = counted.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(words))))
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"n{i}"), F.col(f"d{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))).otherwise(0.0)
    hit = F.lit(False)
    for i in range(len(words)):
        hit = hit | (F.col(f"n{i}") > 0)
    out = counted.where(hit).join(F.broadcast(stats)).select(key, F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(k) if k is not None else out


def page(hits: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """Q-11: the hits of a page, best score first, then by id."""
    return hits.orderBy(F.desc("score"), "dataset_id").offset(offset).limit(size)


def fan_out(index: DataFrame, terms: DataFrame, ratio: float = RATIO) -> DataFrame:
    """O-02: one question for each column (column, place, term); a dataset's first hit, by place and terms matched, is its hit."""
    hits = terms_hits(index, terms, ratio, by=("column", "place"))
    first = F.row_number().over(Window.partitionBy("dataset_id").orderBy("place", F.desc("n_terms"), "offset"))
    return hits.withColumn("_n", first).where("_n = 1").drop("_n")
