"""Session settings that the engine counts on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.python.worker.reuse": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where that is
    unset, a local master gets a temporary folder and any other raises ValueError. It is
    removed when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="eventlake-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)  # only what exists can be marked
    files.deleteOnExit(path)
    return path.toString()


def session(name: str = "eventlake", **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` are further settings with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
