"""Tables cut out of the lineage, written to the folder that every executor shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.session import ship

_KEY = "spark.checkpoint.dir"
#: Rows and bytes (as JSON, which is no shorter than Spark's rows by much) that a broadcast table may have.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow(df: DataFrame, func: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose function may use this package on the executors.

    Where the session doesn't bound Arrow batches by bytes, they are bounded by ``BATCH_BYTES``: by rows alone, a
    batch of long texts or lists takes hundreds of MB on both sides.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(Handing(func), schema)


class Handing:
    """Runs a function over batches and hands its memory back to the machine: workers are used again, and keep
    what their allocators have freed."""

    def __init__(self, func: Callable):
        self.func = func

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from self.func(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass


def shared_dir(spark: SparkSession) -> str:
    """Folder that the cluster names in ``spark.checkpoint.dir``.

    Where that setting is missing, a local folder is made and set on one machine (a local master, as in
    tests); on a cluster RuntimeError is raised, since its machines share no local folder.
    """
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} isn't set: name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a cut in the lineage
    that outlives lost executors. ``forget`` deletes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("_stored_at", None):
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one (through Hadoop's file systems, whatever the scheme)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes."""
    row = F.octet_length(F.to_json(F.struct(*(F.hex(c) if t == "binary" else F.col(c) for c, t in df.dtypes)))).cast("bigint")
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df
