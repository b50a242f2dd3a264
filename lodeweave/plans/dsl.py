"""The JSON query language, validated and compiled to DataFrame predicates (Q-20 to Q-32)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import dates, text
from lodeweave.operators import search
from lodeweave.operators.index import TextIndex
from lodeweave.plans import schema

def validate(query: dict) -> list[str]:
    """What is wrong with a query."""
    return schema.check(schema.QUERY, query)


def dataset_condition(d: dict) -> Column:
    """Conditions on the dataset itself; each given field must hold, of a list any value."""
    parts: list[Column | None] = []
    if d.get("about"):
        parts.append(search.any_field(d["about"]))
    for key, field in (("name", "title"), ("description", "description"), ("keywords", "keywords"), ("url", "url")):
        if d.get(key):
            many = d[key] if isinstance(d[key], list) else [d[key]]
            parts.append(search.any_of(*(search.url_is(x) if field == "url" else search.key_values([(field, x)]) for x in many)))
    for key, field in (("date_published", "date_published"), ("date_created", "date_updated")):
        bounds = d.get(key) or {}
        ts = dates.parse_date(F.col(field))
        for end, test in (("after", lambda t, v: t >= v), ("before", lambda t, v: t <= v)):
            if bounds.get(end):
                parts.append(F.coalesce(test(ts, dates.parse_date(F.lit(bounds[end]))), F.lit(False)))
    for key in ("creator", "publisher"):
        if d.get(key):
            warnings.warn(f"dataset.{key} isn't part of a description and is ignored", stacklevel=3)
    return search.all_of(*parts)


def _terms(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(str(v),) for v in values if isinstance(v, str)] or [(None,)], "term string")


def variable_hits(catalog: DataFrame, index: DataFrame, item: dict, data: DataFrame | None) -> DataFrame:
    """(dataset_id, offset, n_terms) of the variables that an item of the query asks for.

    A stored index (one with buckets) has the entity values, which descriptions then needn't list.
    """
    spark, kind = catalog.sparkSession, item["type"]
    every = search.variables(catalog)
    plain = lambda cond: every.where(cond).select("dataset_id", "offset", F.lit(0).cast("bigint").alias("n_terms"))
    if kind == "dataframe_columns":
        if data is None:
            raise ValueError("dataframe_columns need a table")
        names = item.get("names") or [data.columns[i] for i in item["index"]]
        out = None
        for name in names:  # all columns must be found, each in some variable
            hits = search.terms_hits(index, data.select(F.col(f"`{name}`").cast("string").alias("term"))).select("dataset_id", "offset", "n_terms")
            out = hits if out is None else out.join(hits.select("dataset_id").distinct(), "dataset_id", "left_semi")
        return out
    if kind == "temporal_entity":
        return plain(search.covers(F.col("v"), item.get("start"), item.get("end")))
    if kind == "geospatial_entity":
        return search.terms_hits(index, _terms(spark, (item.get("named_entities") or {}).get("items") or [])).select("dataset_id", "offset", "n_terms")
    conditions = []
    if item.get("named_entities") and "bucket" in index.columns:
        given = item["named_entities"]
        values = given.get("items", []) if isinstance(given, dict) else given
        named = search.phrase_hits(index, [str(x) for x in (values if isinstance(values, list) else [values])])
        every, item = every.join(named, ["dataset_id", "offset"], "left_semi"), {k: v for k, v in item.items() if k != "named_entities"}
    if item.get("about"):
        v = F.col("v")
        own = F.concat_ws(" ", v["name"], v["description"], F.array_join(v["semantic_type"], " "), F.array_join(v["named_entity"], " "))
        conditions.append(F.coalesce(text.has_any(own, F.lit(item["about"])), F.lit(False)))
    for key, field in (("variable_name", "name"), ("variable_semantic_type", "semantic_type"), ("named_entities", "named_entity")):
        if item.get(key):
            values = item[key].get("items", []) if isinstance(item[key], dict) else item[key]
            many = values if isinstance(values, list) else [values]
            one = lambda x: F.coalesce(F.exists(F.col("v")[field], lambda e: text.has_phrase(e, F.lit(x))) if field != "name" else text.has_phrase(F.col("v")[field], F.lit(x)), F.lit(False))  # noqa: B023, E731
            conditions.append(search.any_of(*(one(x) for x in many)))
    return plain(search.all_of(*conditions))


def run(catalog: DataFrame, query: dict, data: DataFrame | None = None, size: int = 20, entities: bool = False, offset: int = 0, index: DataFrame | None = None, texts: TextIndex | None = None) -> DataFrame:
    """A page of ``hits``, best first."""
    return search.page(hits(catalog, query, data, entities, index, texts), size, offset)


def hits(catalog: DataFrame, query: dict, data: DataFrame | None = None, entities: bool = False, index: DataFrame | None = None, texts: TextIndex | None = None) -> DataFrame:
    """All hits of a query, in no order: dataset_id, score, matches (section, i, type, offset), and the description.

    All required variables must be found and one of the desired ones at least; the score is the number of
    terms matched plus one for each match, and with ``about`` the BM25 score of the description's text; 1 where nothing of these is asked.
    index: postings of the entity values (``EntityIndex.postings``), else those that descriptions list; texts: the index of
    the descriptions' texts, else they are read.
    """
    if wrong := validate(query):
        raise ValueError("; ".join(wrong))
    kept = catalog.where(dataset_condition(query.get("dataset") or {}))
    index = search.postings(kept) if index is None else index
    found = None
    for section in ("required_variables", "desired_variables"):
        some = None
        for i, item in enumerate(query.get(section) or []):
            one = variable_hits(kept, index, item, data).select("dataset_id", "n_terms", F.struct(F.lit(section).alias("section"), F.lit(i).alias("i"), F.lit(item["type"]).alias("type"), "offset").alias("match"))
            if section == "required_variables":
                kept = kept.join(one.select("dataset_id").distinct(), "dataset_id", "left_semi")
            some = one if some is None else some.union(one)
        if some is not None:
            if section == "desired_variables":
                kept = kept.join(some.select("dataset_id").distinct(), "dataset_id", "left_semi")
            found = some if found is None else found.union(some)
    if found is None:
        out = kept.withColumns({"score": F.lit(1.0), "matches": F.array().cast("array<struct<section:string,i:int,type:string,offset:int>>")})
    else:
        scored = found.groupBy("dataset_id").agg(F.sum(F.col("n_terms") + 1).cast("double").alias("score"), F.array_sort(F.collect_set("match")).alias("matches"))
        out = kept.join(scored, "dataset_id")
    if about := (query.get("dataset") or {}).get("about"):
        told = texts.score(about).withColumnRenamed("key", "dataset_id") if texts else search.bm25(catalog.withColumn("_text", search.document_text()), about, "dataset_id", "_text")
        out = out.join(told.withColumnRenamed("score", "_told"), "dataset_id", "left")
        out = out.withColumn("score", F.coalesce("_told", F.lit(0.0)) + (F.lit(0.0) if found is None else F.col("score"))).drop("_told")
    if not entities:
        out = out.withColumn("variables", F.transform("variables", lambda v: v.dropFields("named_entity")))
    return out


def join_columns(matches: list, columns: dict[int, list[int]]) -> list[tuple[list[int], int]]:
    """O-06: (left columns, right offset): for each required column item its first offset that isn't used yet."""
    used, out = set(), []
    for i in sorted(columns):
        for m in sorted((m for m in matches if m["section"] == "required_variables" and m["type"] == "dataframe_columns" and m["i"] == i), key=lambda m: m["offset"]):
            if m["offset"] not in used:
                used.add(m["offset"])
                out.append((columns[i], m["offset"]))
                break
    return out
