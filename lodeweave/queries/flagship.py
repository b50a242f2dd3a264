"""Discovery end to end: which dataset holds a table's values, and that dataset joined to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.operators import catalog as store
from lodeweave.operators.index import EntityIndex
from lodeweave.plans import datasets, dsl
from lodeweave.queries.common import CATALOG, catalog, table
from lodeweave.session import shared_path


def discover_and_join(spark: SparkSession, d: str) -> DataFrame:
    """A table of market segments with targets: its values find a dataset in the catalog, which augments it."""
    mine = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("target")).withColumnRenamed("c_mktsegment", "segment")
    hits = dsl.run(catalog(spark, d), {"required_variables": [{"type": "dataframe_columns", "index": [0]}]}, mine, size=1)
    best = hits.select("dataset_id", "matches").first()  # one row
    found, entity, _, _ = next(c for c in CATALOG if c[3] == best["dataset_id"])
    right = table(spark, d, found)
    (_, offset), *_ = dsl.join_columns(best["matches"], {0: [0]})
    assert offset == 0
    right = right.select(entity, "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    return api.augment(mine, right, [[0]], [[0]])[0]


def generate_and_augment(spark: SparkSession, d: str) -> DataFrame:
    """P-01, B-04, Q-01, O-01, J-09: tables are described and saved, their values indexed; a table finds its complement by them, which is loaded by its id and joined."""
    index = EntityIndex(spark, shared_path(spark, "entities"))
    described = lambda name: {"title": name, "materialization": {"source": "parquet", "arguments": {"url": f"{d}/{name}.parquet"}}}
    made = api.index_tables(spark.createDataFrame([], store.SCHEMA), index, [(table(spark, d, name), described(name)) for name in ("customer", "part", "orders", "nation", "region")])
    mine = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("target")).withColumnRenamed("c_mktsegment", "segment")
    hits = api.search(made, {"required_variables": [{"type": "dataframe_columns", "index": [0]}]}, mine, 1, index)
    best = hits.select("dataset_id", "matches").first()  # one row
    right = datasets.load_by_id(made, best["dataset_id"])
    (_, offset), *_ = dsl.join_columns(best["matches"], {0: [0]})
    out = api.augment(mine, right, [[0]], [[offset]])[0]
    return out.select("segment", "target", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


QUERIES = {"discover_and_join": discover_and_join, "generate_and_augment": generate_and_augment}
_SQL = "WITH m AS (SELECT c_mktsegment AS segment, count(*) AS target FROM customer GROUP BY 1) SELECT segment, target, c_custkey, round(c_acctbal, 2) AS c_acctbal FROM m LEFT JOIN customer ON segment = c_mktsegment"
ORACLES = {n: _SQL for n in QUERIES}
