"""Corpus clean-up: each stage is one operator of lodeweave.llm over all rows its predecessor kept.

toxicity drops what the classifier holds toxic; jaccard keeps one document of each group of near
duplicates (the smallest doc_id); decontamination drops documents with a benchmark window in them;
secrets replaces every secret by a mark and keeps the document; sentencepiece adds ids. Clean
documents pass every stage unchanged. Documents whose columns clash with a stage's own names keep
theirs: a stage takes the columns of ``documents`` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import decontam, jaccard, secrets, sentencepiece_codec, toxicity
from lodeweave.llm._store import bounded, forget, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the operator predicts toxic; it learns from ``labels`` and the stage's own input."""
    model = toxicity.fit_tables(spark, docs, sf_dir)
    return toxicity.score(docs.select(*COLUMNS), model, "_toxicity").where(F.col("_toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def without(docs: DataFrame, rows: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` that aren't among ``rows`` (doc_id, text_key), null ids compared as values; ``how``: left_semi for those that are."""
    gone = bounded(rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text_key"))
    return docs.select(*COLUMNS).join(gone, same, how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; repeated rows (equal id and text) become one."""
    found = jaccard.keyed_duplicates(docs.select("doc_id", "text"))
    goes = ~(F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_key") == F.col("group_key")))
    rows = stored(found.groupBy("doc_id", "text_key").agg(F.max(goes).alias("goes"), F.count("*").alias("n")).where("goes or n > 1"), "pipeline-rows")
    kept = without(docs, rows.where("goes"))
    twice = rows.where("not goes")
    if twice.limit(1).count():
        one = without(kept, twice, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("x")).select("doc_id", "text", "x.*")
        kept = without(kept, twice).union(one)
    return kept.select(*COLUMNS)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    bad = stored(decontam.decontaminate(docs.select("doc_id", "text"), benchmark).where("n_hit > 0").select("doc_id", "text_key").distinct(), "pipeline-rows")
    return without(docs, bad)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows where a text changed."""
    found = secrets.scan(docs.select(*COLUMNS), secrets.train(secrets.samples(spark)))
    hit = F.size("spans") > 0
    clean = secrets.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("_clean", clean).select("doc_id", F.col("_clean").alias("text"), "lang", "source", F.when(hit, F.length("_clean")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each text's ids and their number."""
    return sentencepiece_codec.encode(docs.select(*COLUMNS)).withColumn("n_ids", F.size("ids").cast("bigint"))


STAGES = [("toxicity", toxic), ("jaccard", near_duplicates), ("decontamination", contaminated), ("secrets", secret), ("sentencepiece", encoded)]

#: The first stage is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
