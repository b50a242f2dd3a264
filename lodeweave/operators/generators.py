"""Descriptions and tables from crawled data (G-02 to G-07)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import catalog
from lodeweave.sources import readers

#: Fixed value: tables of this score or less aren't described.
SCORE = 0.8


def good_tables(tables: DataFrame, score: str = "score", least: float = SCORE) -> DataFrame:
    """G-02: tables whose score is above the least; tables without a score go."""
    return tables.where(F.col(score) > least)


def n_tables(page: Column) -> Column:
    """G-03: how many tables a page opens, as HTML or in wiki markup; 0 for null."""
    return F.coalesce(F.regexp_count(F.lower(page), F.lit(r"<table\b|\{\|")), F.lit(0)).cast("bigint")


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """G-03: (title, ns, redirect, text) of the pages of an encyclopaedia's XML dump, read in splits by Spark's XML source; redirect is null for articles."""
    kind = "title string, ns int, redirect struct<_title:string>, revision struct<text:string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(kind).load(path)
    return pages.select("title", "ns", F.col("redirect._title").alias("redirect"), F.col("revision.text").alias("text"))


def articles_with_tables(dump: DataFrame) -> DataFrame:
    """G-03: (title, n_tables) of a dump's articles (title, ns, redirect, text) in namespace 0 that aren't redirects and hold a table."""
    return dump.where("ns = 0 and redirect is null").select("title", n_tables(F.col("text")).alias("n_tables")).where("n_tables > 0")


def key_entities(df: DataFrame, separator: str = "_", keep: tuple[str, ...] = ()) -> DataFrame:
    """G-05: (keep.., key, semantic_type, value): distinct values under each key of nested rows, keys joined by the separator.

    List positions belong to the key. A key that ends in ``date`` or ``utc`` is of time, one that ends in ``id`` an
    identifier, any other a text. Nulls aren't values. Rows, not one list a key, since keys can have many values.
    """
    flat = readers.flattened(df, separator)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in flat.columns if c not in keep)))
    ending = F.lower("key")
    kind = F.when(ending.rlike("(date|utc)$"), "Time").when(ending.rlike("(^|[^a-z])id$"), "Identifier").otherwise("Text")
    found = flat.select(*keep, cells.alias("c")).select(*keep, "c.*").where("value is not null").distinct()
    return found.select(*keep, "key", kind.alias("semantic_type"), "value")


def csv_resources(packages: DataFrame) -> DataFrame:
    """G-07: a description for each CSV resource of crawled packages (title, url, tags, resources).

    Resources without a media type, or of another one, go. Keywords are the tags' names that aren't null.
    """
    r = packages.select("title", "url", F.array_compact(F.transform("tags", lambda t: t["name"])).alias("keywords"), F.explode("resources").alias("r"))
    arguments = F.create_map(F.lit("url"), F.col("r.url"), F.lit("file_type"), F.lit("csv"))
    made = r.where(F.contains(F.lower("r.mimetype"), F.lit("csv")))
    return made.select("title", F.col("r.description").alias("description"), "url", "keywords", F.col("r.created").alias("date_published"), F.struct(F.lit("general").alias("source"), arguments.alias("arguments")).alias("materialization"))


@dataclass(frozen=True)
class Variable:
    """A variable of a template: texts and lists are the same in all documents, columns are taken from each row."""

    name: str | Column
    description: str | Column = ""
    semantic_type: Sequence[str] = ()
    named_entity: Column | None = None
    start: Column | None = None
    end: Column | None = None


def _column(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def templated(rows: DataFrame, title: Column, source: str, arguments: Mapping[str, Column | str], variables: Sequence[Variable], description: Column | str = "", url: Column | str | None = None, keywords: Column | None = None, provenance: str | None = None) -> DataFrame:
    """G-06: a description for each row (an indicator, a table, a kind of reading), in the catalog's columns without ids.

    Texts are those of the template, columns are filled in from the row; null texts stay null.
    """
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    none = F.lit(None)
    made = F.array(*(F.struct(
        none.cast("bigint").alias("dataset_id"), _column(v.name).cast("string").alias("name"), _column(v.description).cast("string").alias("description"), texts(v.semantic_type).alias("semantic_type"),
        (none if v.named_entity is None else v.named_entity).cast("array<string>").alias("named_entity"),
        (none.cast("struct<start:string,end:string>") if v.start is None and v.end is None else F.struct(_column(v.start).cast("string").alias("start"), _column(v.end).cast("string").alias("end"))).alias("temporal_coverage"),
        none.cast("string").alias("spatial_coverage"),
    ) for v in variables))
    known = {
        "title": title, "description": _column(description), "url": _column(url), "keywords": none.cast("array<string>") if keywords is None else keywords, "provenance": _column(provenance), "variables": made,
        "materialization": F.struct(F.lit(source).alias("source"), F.create_map(*(x for k, v in arguments.items() for x in (F.lit(k), _column(v).cast("string")))).alias("arguments")),
    }
    return rows.select(*((known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in catalog.SCHEMA))


def united(*lists: DataFrame, by: str) -> DataFrame:
    """G-04, G-06: a row for each value of ``by`` in any of several lists, from the first that has it; nulls go."""
    out = None
    for i, one in enumerate(lists):
        rows = one.where(F.col(by).isNotNull()).withColumn("_list", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (by, "_list")]
    first = F.min_by(F.struct(*rest), "_list") if rest else None
    return out.groupBy(by).agg(first.alias("x")).select(by, "x.*") if rest else out.select(by).distinct()


def category_sets(facts: DataFrame, by: str, subject: str, category: str, separator: str = ";") -> DataFrame:
    """G-04: (by, n_subjects, categories): for each property the number of its distinct subjects and the sorted union of their category sets.

    facts (by, subject, category): categories as texts joined by the separator, as ``readers.sets_by_key`` gives them. Members are counted as rows
    and brought together a property at a time only where they are distinct.
    """
    member = F.explode_outer(F.array_distinct(F.filter(F.split(F.col(category), F.lit(separator)), lambda x: x != "")))
    rows = facts.where(F.col(by).isNotNull()).select(by, subject, member.alias("m"))
    counted = rows.groupBy(by).agg(F.count_distinct(subject).alias("n_subjects"))
    union = rows.where("m is not null").select(by, "m").distinct().groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("m")), separator).alias("categories"))
    return counted.join(union, by, "left").select(by, "n_subjects", F.coalesce("categories", F.lit("")).alias("categories"))


def paged(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """G-04: the rows with their page, from 0, in a stated order: contiguous numbers through a range sort."""
    from lodeweave.operators.joins import with_row_ids

    return with_row_ids(df, order, "_n").withColumn("page", F.expr(f"_n div {int(size)}")).drop("_n")


def bulk_name(address: Column) -> Column:
    """G-06: a dataset's name from a bulk file's address: its words (between underlines, before the first dot) without those with a bracket, lower-cased, hyphens as underlines."""
    words = F.split(F.get(F.split(F.get(F.reverse(F.split(address, "/")), F.lit(0)), r"\."), F.lit(0)), "_")
    return F.replace(F.lower(F.array_join(F.filter(words, lambda w: ~F.contains(w, F.lit("("))), "_")), F.lit("-"), F.lit("_"))
