"""Incremental ingest: new files to a table, and a live time histogram."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources import winlog
from ..sources.winlog import decode_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, *, pattern: str = "*", files_per_trigger: int = 64, **options: object) -> DataFrame:
    """A stream of decoded rows of the log files that come into a folder."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return decode_files(raw, **options)


def stream_chunks(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A stream of decoded rows of log files that come into a folder or grow there, chunk by chunk;
    its offsets are places inside of files (``sources.stream``)."""
    winlog.register(spark)
    reader = spark.readStream.format("winlog")
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(path)


def ingest(rows: DataFrame, table_path: str, checkpoint: str, *, partition_by: str | None = None) -> StreamingQuery:
    """Append what is there to a Parquet table and stop; a later call takes what is new."""
    writer = rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(partition_by) if partition_by else writer).start()


def live_counts(rows: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window; rows later than ``late`` are dropped."""
    return rows.where(F.col("ts").isNotNull()).withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), "cnt")


class Progress(StreamingQueryListener):
    """Calls back with (batch, rows) after each micro-batch."""

    def __init__(self, call: Callable[[int, int], None]):
        self.call = call

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.call(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
