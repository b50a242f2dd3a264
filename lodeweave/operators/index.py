"""Stored inverted indexes: entity values of catalog columns (Q-01, P-01, B-04) and ranked texts (Q-14).

Both are Parquet below a path of any file system, in ``BUCKETS`` folders by a hash of the token, so that a
question reads the folders of its own tokens alone. Executors write them and read them; what comes to the
driver is a row for each word of a question.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.operators import profile

BUCKETS = 64
K1, B = 1.2, 0.75


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    """Appends rows (.., token) by bucket; large buckets are split and small ones joined as they are measured."""
    rows.withColumn("bucket", bucket_of(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("append").partitionBy("bucket").parquet(path)


class EntityIndex:
    """Entity values of datasets' columns, by their words.

    A dataset's values are appended under a generation of their own, and only then the log says that this
    generation is the dataset's: values of a call that failed are never seen, a call repeated replaces what it
    wrote before. ``compact`` drops what no generation in force holds.
    """

    _VALUES = "dataset_id bigint, offset int, value string, padded string, token string, generation string, bucket int"
    _LOG = "dataset_id bigint, sequence bigint, generation string, live boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for schema, p in ((self._LOG, self._log()), (self._VALUES, self._values())):
            folder = spark._jvm.org.apache.hadoop.fs.Path(p)
            if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
                spark.createDataFrame([], schema).write.mode("append").parquet(p)

    def _values(self) -> str:
        return f"{self.path}/values"

    def _log(self) -> str:
        return f"{self.path}/log"

    def _say(self, dataset_id: int, generation: str, live: bool) -> None:
        self.spark.createDataFrame([(dataset_id, time.time_ns(), generation, live)], self._LOG).coalesce(1).write.mode("append").parquet(self._log())

    def add(self, df: DataFrame, dataset_id: int, columns: Mapping[str, int]) -> None:
        """The distinct values of a table's columns, given with their offsets in its description; they replace the dataset's earlier ones."""
        generation = uuid.uuid4().hex
        if columns:
            offset = F.create_map(*(F.lit(x) for pair in columns.items() for x in pair))
            values = profile.entity_values(df, list(columns)).select(F.lit(dataset_id).cast("bigint").alias("dataset_id"), offset[F.col("column")].cast("int").alias("offset"), "value")
            rows = values.select("*", text.padded(F.col("value")).alias("padded"), F.explode(F.array_distinct(text.analyzed(F.col("value")))).alias("token"))
            _write(rows.withColumn("generation", F.lit(generation)), self._values())
        self._say(dataset_id, generation, True)

    def remove(self, dataset_id: int) -> None:
        self._say(dataset_id, uuid.uuid4().hex, False)

    def _current(self) -> DataFrame:
        """(dataset_id, generation) in force."""
        log = self.spark.read.schema(self._LOG).parquet(self._log())
        last = log.groupBy("dataset_id").agg(F.max_by(F.struct("generation", "live"), F.struct("sequence", "generation")).alias("x"))
        return last.where("x.live").select("dataset_id", "x.generation")

    def postings(self) -> DataFrame:
        """(token, dataset_id, offset, value, padded, bucket) for ``search.terms_hits``."""
        values = self.spark.read.schema(self._VALUES).parquet(self._values())
        return values.join(self._current(), ["dataset_id", "generation"]).select("token", "dataset_id", "offset", "value", "padded", "bucket")

    def compact(self, path: str) -> "EntityIndex":
        """A new index at ``path`` with the values in force alone."""
        out, values = EntityIndex(self.spark, path), self.spark.read.schema(self._VALUES).parquet(self._values())
        _write(values.join(self._current(), ["dataset_id", "generation"]).drop("bucket"), out._values())
        self._current().withColumns({"sequence": F.lit(time.time_ns()), "live": F.lit(True)}).select("dataset_id", "sequence", "generation", "live").write.mode("append").parquet(out._log())
        return out


class TextIndex:
    """Texts by their words, for Okapi BM25 (Q-14): postings with term frequency and length, each word's bound, sums of the corpus.

    ``build`` makes one; a key is one text. A null text has no words, and counts as a text.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, corpus: DataFrame, key: str, column: str | Column, path: str, k1: float = K1, b: float = B) -> "TextIndex":
        """Two passes over the corpus: its sums, then the postings."""
        out = cls(corpus.sparkSession, path)
        of = F.col(column) if isinstance(column, str) else column
        rows = corpus.select(F.col(key).alias("key"), text.analyzed(F.coalesce(of, F.lit(""))).alias("t"))
        rows.agg(F.count("*").alias("docs"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("mean"), F.lit(k1).alias("k1"), F.lit(b).alias("b")).write.parquet(f"{out.path}/sums")
        words = rows.select("key", F.size("t").alias("len"), F.explode("t").alias("token")).groupBy("key", "len", "token").agg(F.count("*").alias("tf"))
        weight = out._weight(out._sums())
        _write(words.select("token", "key", "tf", "len", weight.alias("weight")), f"{out.path}/postings")
        postings = out.spark.read.parquet(f"{out.path}/postings")
        postings.groupBy("token").agg(F.count("*").alias("df"), F.max("weight").alias("most")).withColumn("bucket", bucket_of(F.col("token"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{out.path}/words")
        return out

    def _sums(self) -> dict:
        return self.spark.read.parquet(f"{self.path}/sums").first().asDict()

    @staticmethod
    def _weight(sums: dict) -> Column:
        tf = F.col("tf")
        return tf * (sums["k1"] + 1) / (tf + sums["k1"] * (1 - sums["b"] + sums["b"] * F.col("len") / F.lit(sums["mean"])))

    def score(self, query: str, k: int | None = None) -> DataFrame:
        """(key, score), the k best by score and key, or all texts with a word of the query.

        With k the best of a single word bound the k-th score from below. The words whose bounds together stay under it can't lift a text
        into the best on their own: texts are found through the other words, those that can't reach the bound with all that is left go, and only
        for the rest the remaining words' postings are looked up.
        """
        asked = sorted(set(re.findall(r"[^\W_]+", query.lower())))
        sums = self._sums()
        here = F.col("token").isin(asked) & F.col("bucket").isin(self._buckets(asked))
        idf = lambda n: F.log(1 + (sums["docs"] - n + 0.5) / (n + 0.5))
        known = self.spark.read.parquet(f"{self.path}/words").where(here).select("token", idf(F.col("df")).alias("idf"), (idf(F.col("df")) * F.col("most")).alias("most")).collect() if asked else []
        if not known:
            return self.spark.read.parquet(f"{self.path}/postings").select("key", F.lit(0.0).alias("score")).limit(0)
        of = F.create_map(*(F.lit(x) for r in known for x in (r["token"], r["idf"])))
        postings = self.spark.read.parquet(f"{self.path}/postings").where(here).select("token", "key", (of[F.col("token")] * F.col("weight")).alias("part"))
        total = F.round(F.sum("part"), 6).alias("score")
        if k is None:
            return postings.groupBy("key").agg(total)
        bound = self._bound(postings, [r["token"] for r in known], k)
        rest, slack = [], 0.0
        for r in sorted(known, key=lambda r: r["most"]):
            if slack + r["most"] >= bound:
                break
            rest.append(r["token"])
            slack += r["most"]
        found = postings.where(~F.col("token").isin(rest)) if rest else postings
        if rest:
            near = found.groupBy("key").agg(F.sum("part").alias("part")).where(F.col("part") + slack >= bound)
            more = postings.where(F.col("token").isin(rest)).join(near.select("key"), "key", "left_semi")
            found = near.select("key", "part").union(more.select("key", "part"))
        return found.groupBy("key").agg(total).orderBy(F.desc("score"), "key").limit(k)

    def _buckets(self, words: list[str]) -> list[int]:
        rows = self.spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w")).alias("b")).distinct().collect()
        return [r["b"] for r in rows]

    @staticmethod
    def _bound(postings: DataFrame, words: list[str], k: int) -> float:
        """The largest k-th part of any one word, which the k-th score can't be below; 0 if no word has k texts. Less a little, as sums are rounded."""
        best = None
        for w in words:
            kth = postings.where(F.col("token") == w).select("part").orderBy(F.desc("part")).limit(k)
            one = kth.agg(F.when(F.count("*") == k, F.min("part")).alias("kth"))
            best = one if best is None else best.union(one)
        found = best.agg(F.max("kth")).first()[0]
        return max(0.0, (found or 0.0) - 1e-5)
