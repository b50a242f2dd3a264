"""The catalog as a log of changes (B-07, B-08, B-12): a batch is appended, nothing before it is written again.

A batch is a folder of its own with the descriptions that it brought, the ids they got and its place in the log. What is read is, for
each dataset, the row of the latest batch. A batch that is there already is left as it is, so taking it again changes nothing.
``compact`` makes one batch of them all.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.operators import catalog, joins


class CatalogLog:
    """A catalog under a path of any file system."""

    SCHEMA = T.StructType([*catalog.SCHEMA.fields, T.StructField("sequence", T.LongType()), T.StructField("removed", T.BooleanType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _changes(self) -> DataFrame:
        """All rows of finished batches."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/batch=*")

    def _write(self, rows: DataFrame, batch: str, sequence: int) -> None:
        """A batch's folder gets its name when it is whole: readers never see a part of it."""
        hidden = f"{self.path}/_writing-{batch}"
        rows.withColumn("sequence", F.lit(sequence)).select(*self.SCHEMA.names).write.mode("overwrite").parquet(hidden)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(hidden), self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}")):
            raise OSError(f"batch {batch} could not be named")

    def append(self, new: DataFrame, batch: str, order: str = "title") -> bool:
        """Adds a batch of descriptions; False if the log has it already.

        A dataset that the log has keeps its id; others get the next ids, numbered by a range sort in the stated order. Of several
        descriptions of one dataset the last in that order holds. Of the log only ids and what tells datasets apart are read, and only the batch is written.
        """
        if self._exists(f"{self.path}/batch={batch}"):
            return False
        n = new.withColumn("_k", catalog.identity(new))
        n = n.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        current = self._changes()
        known = current.select(catalog.identity(current).alias("_known"), "dataset_id").groupBy("_known").agg(F.min("dataset_id").alias("_id"))
        found = n.join(known, n["_k"].eqNullSafe(known["_known"]), "left").drop("_k", "_known", "dataset_id")
        fresh = joins.with_row_ids(found.where("_id is null"), [order], "_rank")
        base = catalog.next_id(current)
        given = fresh.join(F.broadcast(base)).withColumn("dataset_id", F.col("next_id") + F.col("_rank") * catalog.STEP)
        both = found.where("_id is not null").withColumn("dataset_id", F.col("_id")).select(*catalog.SCHEMA.names).unionByName(given.select(*catalog.SCHEMA.names))
        both = both.withColumn("variables", catalog.renumbered(F.col("variables"), F.col("dataset_id"))).withColumn("removed", F.lit(False))
        self._write(both, batch, time.time_ns())
        return True

    def remove(self, ids: DataFrame, batch: str) -> bool:
        """Takes datasets (dataset_id) out of the catalog; their ids aren't given again."""
        if self._exists(f"{self.path}/batch={batch}"):
            return False
        current = self.read().join(ids.select("dataset_id").distinct(), "dataset_id", "left_semi")
        self._write(current.withColumn("removed", F.lit(True)), batch, time.time_ns())
        return True

    def read(self) -> DataFrame:
        """The catalog: each dataset's latest description."""
        rows = self._changes()
        last = rows.groupBy("dataset_id").agg(F.max_by(F.struct(*(c for c in self.SCHEMA.names if c != "dataset_id")), "sequence").alias("x"))
        return last.where("not x.removed").select("dataset_id", *(f"x.{c}" for c in catalog.SCHEMA.names if c != "dataset_id")).select(*catalog.SCHEMA.names)

    def compact(self, path: str) -> "CatalogLog":
        """The same catalog as one batch of a new log; what was removed stays noted, without its description."""
        out, rows = CatalogLog(self.spark, path), self._changes()
        last = rows.groupBy("dataset_id").agg(F.max_by(F.struct(*(c for c in self.SCHEMA.names if c != "dataset_id")), "sequence").alias("x"))
        flat = last.select("dataset_id", *(f"x.{c}" for c in self.SCHEMA.names if c != "dataset_id"))
        slim = flat.withColumns({c: F.when(~F.col("removed"), F.col(c)) for c in ("variables", "description", "keywords", "additional_info")})
        out._write(slim, "compacted", time.time_ns())
        return out
