"""Shared by the query modules: tables, and a demonstration catalog made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import catalog as store

#: table, entity column, date column, dataset id
CATALOG = [
    ("region", "r_name", None, 0), ("nation", "n_name", None, 10_000), ("customer", "c_mktsegment", None, 20_000), ("part", "p_brand", None, 30_000),
    ("part", "p_type", None, 40_000), ("orders", "o_orderpriority", "o_orderdate", 50_000), ("events", "event_type", "ts", 60_000), ("documents", "lang", None, 70_000),
    ("lineitem", "l_returnflag", "l_shipdate", 80_000),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description of each CATALOG line: one variable of entities and, with a date column, one of times."""
    out = None
    for t, entity, date, i in CATALOG:
        df = table(spark, sf_dir, t)
        aggs = [F.array_sort(F.collect_set(entity)).alias("e")]
        aggs += [F.date_format(f(date), "yyyy-MM-dd'T'HH:mm:ss").alias(n) for f, n in ((F.min, "s"), (F.max, "t"))] if date else [F.lit(None).cast("string").alias(n) for n in "st"]
        made = df.agg(*aggs).select(F.to_json(F.struct(
            F.lit(i).alias("dataset_id"), F.lit(f"{t} by {entity}").alias("title"), F.lit(f"Table {t} of the sample warehouse").alias("description"), F.lit(f"http://data.example.org/{t}.csv").alias("url"),
            F.array(F.lit(t), F.lit("sample")).alias("keywords"), F.lit(f"20{10 + i // 10_000}-01-15").alias("date_published"),
            F.array(F.struct(F.lit(i + 1).alias("dataset_id"), F.lit(entity).alias("name"), F.lit(f"column name: {entity}, dtype: string").alias("description"), F.col("e").alias("named_entity"), F.lit(None).cast("struct<start:string,end:string>").alias("temporal_coverage")),
                    *([F.struct(F.lit(i + 2).alias("dataset_id"), F.lit(date).alias("name"), F.lit(f"column name: {date}, dtype: timestamp").alias("description"), F.lit(None).cast("array<string>").alias("named_entity"), F.struct(F.col("s").alias("start"), F.col("t").alias("end")).alias("temporal_coverage"))] if date else [])).alias("variables"),
            F.struct(F.lit("general").alias("source"), F.create_map(F.lit("url"), F.lit(f"http://data.example.org/{t}.csv"), F.lit("index"), F.lit(entity)).alias("arguments")).alias("materialization"),
        )).alias("line")).select(F.from_json("line", store.SCHEMA).alias("d")).select("d.*")
        out = made if out is None else out.unionByName(made)
    # a description is a row: what is collected has len(CATALOG) rows, and later plans start from a finished catalog
    return spark.createDataFrame(out.collect(), store.SCHEMA)


def _variables_sql() -> str:
    parts = []
    for t, entity, date, i in CATALOG:
        parts.append(f"SELECT {i} AS dataset_id, 0 AS off, '{entity}' AS name, (SELECT list(DISTINCT {entity}) FROM {t}) AS ents, NULL AS s, NULL AS e")
        if date:
            parts.append(f"SELECT {i}, 1, '{date}', NULL, (SELECT min({date}) FROM {t}), (SELECT max({date}) FROM {t})")
    return " UNION ALL ".join(parts)


def _datasets_sql() -> str:
    return " UNION ALL ".join(f"SELECT {i} AS dataset_id, '{t} by {e}' AS title, 'Table {t} of the sample warehouse' AS description, 'http://data.example.org/{t}.csv' AS url, ['{t}', 'sample'] AS keywords, DATE '20{10 + i // 10_000}-01-15' AS published" for t, e, _, i in CATALOG)


#: CTEs of the same catalog in SQL; words(x): its words, padded(x): them between blanks.
SQL = f"WITH vars AS ({_variables_sql()}), sets AS ({_datasets_sql()})"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def padded_sql(x: str) -> str:
    return f"(' ' || array_to_string({words_sql(x)}, ' ') || ' ')"


def number_sql(x: str) -> str:
    return f"coalesce(regexp_matches(trim(CAST({x} AS VARCHAR)), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'), false)"
