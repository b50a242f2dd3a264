"""search, augment, join, generate_metadata, upload: what a user calls (O-01, O-02, J-09, B-06, B-10, B-13 to B-15)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import html
from lodeweave.operators import catalog as store
from lodeweave.operators import joins, profile, search as predicates
from lodeweave.operators.index import EntityIndex, TextIndex
from lodeweave.operators.log import CatalogLog
from lodeweave.plans import datasets, dsl, features, schema
from lodeweave.sources import readers, remote  # noqa: F401  remote registers the JDBC reader


def generate_metadata(df: DataFrame, description: dict | None = None, entities: int | None = None, listed: bool = True) -> dict:
    """P-05 to P-08, P-11, B-04 to B-06: a description of a table; what is given wins, the profile fills gaps.

    A variable whose ``named_entity`` or ``temporal_coverage`` is given as None is profiled; one without
    the key is profiled only if it has no description either. All values of a column are listed, in their order,
    or the first ``entities`` where a number is given; with ``listed`` false none, for an index of values (see
    ``index_tables``): the list is there and empty.
    """
    given = dict(description or {})
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    strings = profile.string_columns(df)
    times = [f.name for f in df.schema if f.dataType.simpleString() in ("timestamp", "timestamp_ntz", "date")]
    variables = {v.get("name"): dict(v) for v in given.get("variables") or []}
    wants = lambda c, k: (variables.get(c, {}).get(k, "absent") is None) or (k not in variables.get(c, {}) and not variables.get(c, {}).get("description"))
    able = {r["column"] for r in profile.entity_columns(df, strings).collect() if r["is_entity"]} if strings else set()
    asked = [c for c in strings if (c in able and wants(c, "named_entity")) or variables.get(c, {}).get("named_entity", "") is None]
    values: dict[str, list[str]] = {c: [] for c in asked}
    if asked and listed:
        found = profile.entity_values(df, asked)
        if entities is not None:
            found = found.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("_n") <= entities)
        for r in found.orderBy("column", "value").toLocalIterator():
            values[r["column"]].append(r["value"])
    dated = [c for c in [*strings, *times] if wants(c, "temporal_coverage")]
    coverage = {r["column"]: {"start": r["start"], "end": r["end"]} for r in profile.temporal_coverage(df, dated).collect()} if dated else {}
    out = []
    for i, c in enumerate(df.columns):
        v = {"name": c, "description": f"column name: {c}, dtype: {types[c]}", "semantic_type": []}
        if c in values:
            v["named_entity"] = values[c]
        if c in coverage and (coverage[c]["start"] or variables.get(c, {}).get("temporal_coverage", "") is None):
            v["temporal_coverage"] = coverage[c]
        out.append(v | {k: x for k, x in variables.get(c, {}).items() if x is not None})
    base = {"title": " ".join(df.columns), "description": ", ".join(f"{c} : {t}" for c, t in types.items()), "keywords": list(df.columns)}
    return base | {k: v for k, v in given.items() if v is not None} | {"variables": out}


def describe_url(spark: SparkSession, url: str, **arguments: str) -> dict:
    """B-14: metadata of a table at an address; addresses that aren't data files raise ValueError."""
    name = url.split("?")[0].rstrip("/").rsplit("/", 1)[-1]
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending in html.SKIPPED_SUFFIXES:
        raise ValueError(f"{url} doesn't look like data")
    materialization = {"source": "general", "arguments": {"url": url, **arguments}}
    df = readers.load(spark, {"materialization": materialization})
    return generate_metadata(df, {"title": name.rsplit(".", 1)[0], "url": url, "materialization": materialization})


def describe_tables(spark: SparkSession, url: str, file_type: str | None = None) -> list[dict]:
    """B-14: a description for each sheet of a workbook or table of a page, which its ``index`` tells apart; one for any other file.

    Tables without columns or rows aren't described.
    """
    kind = {"file_type": file_type} if file_type else {}
    n = readers.n_parts(spark, url, file_type)
    if n is None:
        return [describe_url(spark, url, **kind)]
    made = (describe_url(spark, url, index=str(i), **kind) for i in range(n))
    return [d for d in made if d["variables"]]


def describe_pages(spark: SparkSession, pages: DataFrame) -> tuple[list[dict], list[tuple[str, str]]]:
    """B-15: the descriptions of all data files that pages link to, each address once, and (address, why) of those that can't be read.

    Every file is a load of its own, so files are taken one after the other; their rows stay on the cluster.
    """
    links = describe_links(pages).groupBy("url").agg(F.min("title").alias("title")).orderBy("url")
    made, failed = [], []
    for r in links.toLocalIterator():
        try:
            made += [{**d, "title": r["title"] or d["title"]} for d in describe_tables(spark, r["url"])]
        except Exception as e:  # noqa: BLE001  one bad file of many is reported, not fatal
            failed.append((r["url"], str(e).split("\n")[0]))
    return made, failed


def refreshed(catalog: DataFrame, dataset_id: int) -> DataFrame:
    """B-10: the catalog with one dataset profiled anew; what was profiled before gives way, what was told stays."""
    old = datasets.described(catalog, dataset_id)
    told = [{k: v for k, v in x.items() if k not in ("named_entity", "temporal_coverage", "description")} for x in old.get("variables") or []]
    made = generate_metadata(datasets.load_by_id(catalog, dataset_id), {**old, "variables": told})
    new = store.documents(catalog.sparkSession, [made])
    return store.replace(catalog, new.withColumn("variables", store.renumbered(F.col("variables"), F.col("dataset_id"))))


def describe_links(pages: DataFrame) -> DataFrame:
    """B-15: (page_id, title, url) of the data files that pages link to; dull link texts give way to the file's name."""
    found = html.links(pages).where(html.url_valid(F.col("href")) & html.looks_like_data(F.col("href")))
    name = F.regexp_extract(F.regexp_replace("href", r"[?#].*$", ""), r"/([^/]*)/*$", 1)
    return found.select("page_id", F.when(html.dull_title(F.col("text")), name).otherwise(F.col("text")).alias("title"), F.col("href").alias("url"))


def upload(catalog: DataFrame, descriptions: Sequence[dict]) -> DataFrame:
    """B-12, B-13: the catalog with the valid descriptions, new or renewed; invalid ones are skipped."""
    good = [{**d, "status": "not_profiled"} for d in descriptions if not store.validate(d)]
    return store.upsert(catalog, store.documents(catalog.sparkSession, good)) if good else catalog


def upload_lines(log: CatalogLog, lines: DataFrame, batch: str) -> DataFrame:
    """B-12, B-13, B-16: appends the valid descriptions among JSON lines (line) to a catalog's log; the others come back with their violations.

    Lines are checked by one projection and stay on the cluster.
    """
    checked = schema.violations(lines.select("line"))
    good = checked.where(F.size("violations") == 0).select(F.from_json("line", store.SCHEMA).alias("d")).select("d.*").withColumn("status", F.lit("not_profiled"))
    log.append(good, batch)
    return checked.where(F.size("violations") > 0)


def index_tables(catalog: DataFrame, index: EntityIndex, tables: Sequence[tuple[DataFrame, dict]]) -> DataFrame:
    """P-01, B-04, B-12: the catalog with the described tables, whose entity values executors write to the index.

    Descriptions are saved under the ids that the catalog gives them, or has for them, without lists of values: no column's values pass the driver,
    whatever their number. Descriptions that ``catalog.validate`` rejects raise ValueError.
    """
    made = [generate_metadata(df, description, listed=False) for df, description in tables]
    if wrong := [f"{d.get('title')}: {'; '.join(w)}" for d in made if (w := store.validate(d))]:
        raise ValueError(" ".join(wrong))
    new = store.documents(catalog.sparkSession, made)
    out = store.upsert(catalog, new)
    key = store.identity(out)
    given = {tuple(r["k"]): r["dataset_id"] for r in out.join(new.select(store.identity(new).alias("_k")).distinct(), key.eqNullSafe(F.col("_k"))).select(key.alias("k"), "dataset_id").collect()}  # a row for each table
    for (df, _), d, k in zip(tables, made, (tuple(r["k"]) for r in new.select(store.identity(new).alias("k")).collect())):
        index.add(df, given[k], {v["name"]: i for i, v in enumerate(d["variables"]) if "named_entity" in v})
    return out


def search(catalog: DataFrame, query: dict | None = None, data: DataFrame | None = None, size: int = 20, index: EntityIndex | None = None, texts: TextIndex | None = None) -> DataFrame:
    """O-01, O-02: hits of a query; with data and no required variables, each able column of it is asked at once.

    index, texts: stored indexes of the catalog's entity values and texts.
    """
    query, postings = dict(query or {}), index.postings() if index else None
    if query.get("required_variables") or data is None:
        return dsl.run(catalog, query, data, size, index=postings, texts=texts)
    able = [r["column"] for r in profile.entity_columns(data).collect() if r["is_entity"]]
    kept = dsl.hits(catalog, query, index=postings, texts=texts)
    if not able:
        return kept.limit(0)
    place = F.create_map(*(F.lit(x) for i, c in enumerate(able) for x in (c, i)))
    terms = profile.entity_values(data, able).select("column", place[F.col("column")].alias("place"), F.col("value").alias("term"))
    hits = predicates.fan_out(predicates.postings(catalog) if postings is None else postings, terms)
    best = hits.select("dataset_id", F.col("n_terms").cast("double").alias("_score"), F.array(F.struct(F.lit("required_variables").alias("section"), F.col("place").alias("i"), F.lit("dataframe_columns").alias("type"), "offset")).alias("_m"))
    out = kept.join(best, "dataset_id").withColumns({"score": F.col("_score"), "matches": F.col("_m")}).drop("_score", "_m")
    return predicates.page(out, size)


def augment(left: DataFrame, right: DataFrame, left_columns: Sequence[Sequence[int]], right_columns: Sequence[Sequence[int]], joiner: str = "default", left_id: str | None = None, right_id: str | None = None, implicit: Sequence[dict] = ()) -> tuple[DataFrame, DataFrame | None]:
    """J-00, J-09: the left table with the right one's columns, and the matches of a linkage.

    joiner: "default" (equi left join), "fuzzy" or "exact_match"; linkages need ids of both sides (see
    ``joins.with_row_ids``). An unknown joiner warns and leaves the left table as it is.
    """
    if not left_columns or not right_columns:
        raise ValueError("join columns of both sides are needed")
    right = readers.with_implicit(right, implicit)
    if joiner == "default":
        return joins.equi_left_join(left, right, [left.columns[g[0]] for g in left_columns], [right.columns[g[0]] for g in right_columns]), None
    if joiner not in ("fuzzy", "exact_match"):
        warnings.warn(f"no joiner named {joiner}; the left table is returned", stacklevel=2)
        return left, None
    if left_id is None or right_id is None:
        raise ValueError("a linkage needs ids of both sides")
    return joins.fuzzy_join(left, right, left_id, right_id, features.plan(left, right, left_columns, right_columns), exact=joiner == "exact_match")


def augment_from(catalog: DataFrame, data: DataFrame, dataset_id: int, left_columns: Sequence[Sequence[int | str]], right_columns: Sequence[Sequence[int | str]], joiner: str = "default", constraints: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """J-09: a table joined straight to a dataset of the catalog, and the matches of a linkage.

    The dataset is loaded by its id with the given constraints and its implicit variables; columns are positions or names, on the right those of the
    description, or else those of the table. Linkages look at the columns that are joined by alone, and number the rows of both sides by them.
    """
    description = datasets.described(catalog, dataset_id)
    right = datasets.load_by_id(catalog, dataset_id, constraints=constraints)
    told = [v["name"] for v in readers.implicit_metadata(description, description.get("implicit_variables") or [])["variables"]]
    names = told if told and set(told) <= set(right.columns) else right.columns
    left_at, right_at = datasets.join_indices(data, [{"name": n} for n in names], left_columns, right_columns)
    right_at = [[right.columns.index(names[i]) for i in g] for g in right_at]
    if joiner not in ("fuzzy", "exact_match"):
        return augment(data, right, left_at, right_at, joiner)
    used = [right.columns[i] for g in right_at for i in g]  # alone looked at to plan the linkage
    left = joins.with_row_ids(data, [data.columns[i] for g in left_at for i in g], "_left_id")
    right = joins.with_row_ids(right, used, "_right_id")
    out, matches = augment(left, right, left_at, right_at, joiner, "_left_id", "_right_id")
    return out.drop("_left_id"), matches
