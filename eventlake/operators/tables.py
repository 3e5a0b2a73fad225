"""Lifecycle of the logs table, the catalogue of stored files, and user functions over records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..binxml.reader import CHUNK, HEADER_BLOCK
from ..functions.scalars import file_id
from ..schema import LOGS
from .columns import system_of

SESSION = "session_id"
FILE_CATALOGUE = "file_id string, name string, size long, path string, pinned boolean, last_opened timestamp, chunk_count long"


def create_logs(spark: SparkSession, name: str, *, more: T.StructType | None = None, partition_by: str = "Channel") -> None:
    """``CREATE TABLE IF NOT EXISTS`` with the viewer's columns, as Parquet partitioned by channel."""
    fields = [*LOGS.fields, *(more.fields if more else []), T.StructField(SESSION, T.StringType())]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fields)}) USING parquet PARTITIONED BY (`{partition_by}`)")


def append_logs(rows: DataFrame, name: str, session: str | None = None) -> None:
    """Append the table's columns of decoded rows under a session's id; rows with an error are
    left out. Parquet files of a running append may be seen before it ends, so a reader takes
    one session (``of_session``) once its append has returned."""
    columns = rows.sparkSession.table(name).columns
    kept = rows.where("error IS NULL") if "error" in rows.columns else rows
    kept.withColumn(SESSION, F.lit(session).cast("string")).select(*columns).write.mode("append").insertInto(name)


def of_session(spark: SparkSession, name: str, session: str) -> DataFrame:
    """The rows that one session appended; those of stale sessions stay out."""
    return spark.table(name).where(F.col(SESSION) == session)


def clear_logs(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def catalogue_entry(files: DataFrame, *, chunks: Column | None = None) -> DataFrame:
    """Catalogue rows of files (path, length): the id is name and size."""
    name = F.element_at(F.split("path", "/"), -1)
    count = F.greatest(F.floor((F.col("length") - HEADER_BLOCK) / CHUNK), F.lit(0)) if chunks is None else chunks
    return files.select(file_id(name, F.col("length")).alias("file_id"), name.alias("name"), F.col("length").alias("size"), "path", F.lit(False).alias("pinned"), F.current_timestamp().alias("last_opened"), count.cast("long").alias("chunk_count"))


def merged_catalogue(known: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue with new entries: of one id, a pin stays and the latest opening counts."""
    both = known.unionByName(new)
    return both.groupBy("file_id").agg(F.max_by(F.struct("name", "size", "path", "chunk_count"), "last_opened").alias("e"), F.max("pinned").alias("pinned"), F.max("last_opened").alias("last_opened")).select("file_id", "e.name", "e.size", "e.path", "pinned", "last_opened", "e.chunk_count")


def pinned(known: DataFrame, id: str, on: bool = True) -> DataFrame:
    return known.withColumn("pinned", F.when(F.col("file_id") == id, F.lit(on)).otherwise(F.col("pinned")))


def without_file(known: DataFrame, id: str) -> DataFrame:
    return known.where(F.col("file_id") != id)


def chunk_bytes(files: DataFrame, n: Column | int, *, content: str = "content") -> DataFrame:
    """The n-th chunk's bytes of each file; the header block before it counts."""
    start = (F.lit(n) if isinstance(n, int) else n).cast("int") * CHUNK + HEADER_BLOCK + 1
    return files.withColumn("chunk", F.substring(F.col(content), start, F.lit(CHUNK)))


def json_values(records: DataFrame) -> DataFrame:
    """Raw as VARIANT in ``value``; null where it's no JSON."""
    return records.withColumn("value", F.try_parse_json("Raw"))


def event_data_map(records: DataFrame) -> DataFrame:
    """Named event data as MAP<STRING, STRING>, read from Raw once."""
    return records.withColumn("event_data", F.from_json(F.get_json_object("Raw", "$.Event.EventData"), "map<string,string>"))


def shredded(records: DataFrame) -> DataFrame:
    """Records with Raw read once, at ingest: ``system`` (typed fields of the System object),
    ``event_data`` (MAP<STRING, STRING>) and ``value`` (the whole record as VARIANT). Filters on event
    data, shown columns and pages take these where a table has them and leave Raw unread."""
    data = F.from_json(F.get_json_object("Raw", "$.Event.EventData"), "map<string,string>")
    return records.select("*", system_of(F.col("Raw")).alias("system"), data.alias("event_data"), F.try_parse_json("Raw").alias("value"))


def map_records(records: DataFrame, f: Callable[[dict], dict | None], schema: T.StructType | str) -> DataFrame:
    """A user function over each record (a dict with ``error`` set where it's damaged), in
    Arrow batches; None drops the record."""
    made = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(made)
        for batch in batches:
            rows = [r for r in map(f, batch.to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return records.mapInArrow(run, made)


def progress(done: int, total: int) -> float:
    return 1.0 if total <= 0 else min(1.0, (done + 1) / total)
