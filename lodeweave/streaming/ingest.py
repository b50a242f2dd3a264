"""A catalog kept up to date from a folder of descriptions (B-08): each file is taken once, as it comes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodeweave.operators import catalog
from lodeweave.operators.log import CatalogLog


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends new description files (a JSON object a line) to the catalog's log at ``target``; stops when all are taken.

    Each micro-batch is a batch of the log, named by the checkpoint's query and the batch's number: what it writes is in proportion to itself, one
    that is tried again changes nothing, and a stream with a new checkpoint goes on with the catalog that is there.
    """
    stream, log = spark.readStream.schema(catalog.SCHEMA).json(folder), CatalogLog(spark, target)

    def take(batch: DataFrame, n: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        log.append(batch, f"{query}-{n}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
