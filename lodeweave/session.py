"""A session with the settings that the library is tuned for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "lodeweave", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a Spark application, so that their Python finds it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lodeweave-code-"), "lodeweave_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``.

    Without that setting a folder is made on a local master alone; on a cluster, whose machines share no local
    folder, RuntimeError is raised.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{key} isn't set: name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set(key, found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
