"""The catalog of dataset descriptions: ids, renumbering, upsert, duplicates, files (B-01 to B-17, K-02, K-03)."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.operators import joins
from lodeweave.plans import schema

STEP = 10_000
_S, _L = T.StringType(), T.LongType()
VARIABLE = T.StructType([
    T.StructField("dataset_id", _L), T.StructField("name", _S), T.StructField("description", _S), T.StructField("semantic_type", T.ArrayType(_S)),
    T.StructField("named_entity", T.ArrayType(_S)), T.StructField("temporal_coverage", T.StructType([T.StructField("start", _S), T.StructField("end", _S)])), T.StructField("spatial_coverage", _S),
])
SCHEMA = T.StructType([
    T.StructField("dataset_id", _L), T.StructField("title", _S), T.StructField("description", _S), T.StructField("url", _S), T.StructField("keywords", T.ArrayType(_S)),
    T.StructField("date_published", _S), T.StructField("date_updated", _S), T.StructField("license", _S), T.StructField("provenance", _S), T.StructField("additional_info", _S),
    T.StructField("implicit_variables", T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("name", "value", "semantic_type")]))), T.StructField("variables", T.ArrayType(VARIABLE)),
    T.StructField("materialization", T.StructType([T.StructField("source", _S), T.StructField("arguments", T.MapType(_S, _S))])), T.StructField("status", _S),
])


def create(spark: SparkSession, name: str, path: str | None = None) -> bool:
    """B-01: an empty catalog table, at ``path`` or in the warehouse; False if there is one of that name, which stays."""
    if exists(spark, name):
        return False
    spark.createDataFrame([], SCHEMA).write.format("parquet").options(**({"path": path} if path else {})).saveAsTable(name)
    return True


def exists(spark: SparkSession, name: str) -> bool:
    """B-01."""
    return spark.catalog.tableExists(name)


def drop(spark: SparkSession, name: str) -> bool:
    """B-01: whether there was such a table; a table made at a path of its own leaves its files."""
    there = exists(spark, name)
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})
    return there


def documents(spark: SparkSession, docs: Iterable[dict]) -> DataFrame:
    """A catalog of descriptions given as dictionaries; unknown fields are left out."""
    lines = [(json.dumps(d),) for d in docs]
    return spark.createDataFrame(lines, "line string").select(F.from_json("line", SCHEMA).alias("d")).select("d.*")


def next_id(catalog: DataFrame) -> DataFrame:
    """B-02: the id that the next dataset gets: 0, or a step beyond the largest."""
    return catalog.agg(F.coalesce(F.max("dataset_id") + STEP, F.lit(0)).cast("bigint").alias("next_id"))


def renumbered(variables: Column, dataset_id: Column) -> Column:
    """B-03: variables with ids dataset_id + position + 1; a dataset has fewer than STEP variables."""
    return F.transform(variables, lambda v, i: v.withField("dataset_id", dataset_id + i + 1))


def insert(catalog: DataFrame, new: DataFrame, order: str = "title") -> DataFrame:
    """B-07: the catalog and the new descriptions, which get the next ids in the stated order."""
    ranked = joins.with_row_ids(new.drop("dataset_id"), [order], "_rank")
    given = ranked.crossJoin(F.broadcast(next_id(catalog))).withColumn("dataset_id", F.col("next_id") + F.col("_rank") * STEP).drop("next_id", "_rank")
    given = given.withColumn("variables", renumbered(F.col("variables"), F.col("dataset_id")))
    return catalog.unionByName(given.select(*catalog.columns))


def identity(doc: DataFrame) -> Column:
    """B-11: what makes two descriptions the same dataset: source, url, and index or xpath of the table in it."""
    a = F.col("materialization.arguments")
    return F.struct(F.col("materialization.source").alias("source"), a["url"].alias("url"), F.coalesce(a["index"], a["xpath"]).alias("part"))


def existing(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose identity the catalog has."""
    keys = catalog.select(identity(catalog).alias("_k")).distinct()
    n = new.withColumn("_k", identity(new))
    return n.join(keys, n["_k"].eqNullSafe(keys["_k"]), "left_semi").drop("_k")


def upsert(catalog: DataFrame, new: DataFrame, order: str = "title") -> DataFrame:
    """B-12, B-13: descriptions that the catalog has replace the old ones under their ids; others are inserted."""
    n, c = new.withColumn("_k", identity(new)), catalog.withColumn("_k", identity(catalog))
    old = c.groupBy("_k").agg(F.min("dataset_id").alias("_id"))
    found = n.join(old, n["_k"].eqNullSafe(old["_k"]), "left").select(*(n[x] for x in n.columns), "_id")
    # of several new descriptions of one dataset the last in the stated order holds
    last = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc(order)))
    found = found.withColumn("_n", last).where("_n = 1")
    renewed = found.where("_id is not null").withColumn("dataset_id", F.col("_id"))
    renewed = renewed.withColumn("variables", renumbered(F.col("variables"), F.col("dataset_id"))).select(*catalog.columns)
    kept = catalog.join(renewed.select("dataset_id"), "dataset_id", "left_anti").select(*catalog.columns)
    return insert(kept.unionByName(renewed), found.where("_id is null").select(*catalog.columns), order)


def replace(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """B-09: descriptions under the ids that they carry."""
    return catalog.join(new.select("dataset_id"), "dataset_id", "left_anti").select(*catalog.columns).unionByName(new.select(*catalog.columns))


def intersection(first: DataFrame, *others: DataFrame, prefer: str | None = None) -> DataFrame:
    """B-17: rows of the first list whose ids all others have.

    prefer: a list column (such as ``matches``); of the rows that the lists have for an id the first one with something in it is taken.
    """
    lists = [first, *others]
    out = first
    for o in others:
        out = out.join(o.select("dataset_id").distinct(), "dataset_id", "left_semi")
    if prefer is None:
        return out
    every = None
    for i, one in enumerate(lists):
        ranked = one.select(*first.columns).withColumn("_rank", F.struct((F.coalesce(F.size(prefer), F.lit(0)) <= 0).alias("none"), F.lit(i).alias("list")))
        every = ranked if every is None else every.unionByName(ranked)
    best = every.join(out.select("dataset_id").distinct(), "dataset_id", "left_semi").groupBy("dataset_id").agg(F.min_by(F.struct(*first.columns), "_rank").alias("x"))
    return best.select("x.*")


def save_lines(catalog: DataFrame, path: str) -> None:
    """K-02: two lines for each description, its id and its JSON."""
    catalog.select(F.concat(F.col("dataset_id").cast("string"), F.lit("\n"), F.to_json(F.struct(*catalog.columns))).alias("value")).write.mode("append").text(path)


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """K-03: a catalog of such files; the JSON lines carry their ids, so the id lines only need to be skipped."""
    return spark.read.text(path).where("value like '{%'").select(F.from_json("value", SCHEMA).alias("d")).select("d.*")


def validate(doc: dict) -> list[str]:
    """B-16: what is wrong with a description; ``schema.violations`` says it of many at once."""
    return schema.check(schema.DESCRIPTION, doc)
