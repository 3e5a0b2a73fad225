"""A chunk index over log files: zone maps that skip chunks, and facet counts that merge.

The index is a Parquet table with a row for each chunk of each version of a file (size and
time of change): bounds of record ids and times, and the chunk's counts by level, provider,
channel and event id. ``update`` scans only what has no rows for its present version, so it
can follow an ingest; it only appends.

A read joins the files as they are now with their rows and leaves out chunks that can't have
a row which the filter keeps; only what is left is opened, by tasks of neighbouring chunks.
Files and chunks that the index doesn't know are opened. Each read is a plan of its own, so
several filters don't disturb each other. The filter is applied to the rows as well.

Facet counts of any set of indexed files come from the index alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binxml.reader import CHUNK, HEADER_BLOCK, error, file_header
from ..binxml.values import DecodeError
from ..operators.columns import Columns
from ..operators.filters import Filters, in_ranges
from . import winlog

#: A file's version is its size and the time of its last change.
VERSION = "file string, size long, modified long"
_STATE = "records long, errors long, untimed long, first_id long, last_id long, first_ts timestamp, last_ts timestamp, facets array<struct<facet:string,key:string,cnt:long>>"
INDEX = f"{VERSION}, chunk_no int, {_STATE}"


def listing(spark: SparkSession, path: str, *, recursive: bool = False, extensions: str = "") -> DataFrame:
    """(file, size, modified in ns) of the files at the paths, as they are now."""
    found = winlog.expand_paths([p.strip() for p in path.split(",") if p.strip()], recursive=recursive, extensions=tuple(e.strip().lower().lstrip(".") for e in extensions.split(",") if e.strip()))
    rows = []
    for name, size in found:
        fs, inner = winlog._open(name)
        rows.append((name, size, fs.get_file_info(inner).mtime_ns))
    return spark.createDataFrame(rows, VERSION)


def places(files: DataFrame) -> DataFrame:
    """A row for each chunk that files (with ``size``) have room for; one for a file without any."""
    room = F.greatest(F.floor((F.col("size") - HEADER_BLOCK) / CHUNK).cast("int"), F.lit(1))
    return files.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), room - 1)))


def scan(chunks: DataFrame, *, tasks: int | None = None, **options: object) -> DataFrame:
    """Open the given chunks (file, size, chunk_no) and no others, in a view of the source.
    Neighbours are read by one task, in order; a file's header is read once a task."""
    o = winlog.Options.of({k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()})
    if o.view == "files":
        raise ValueError("the view files has no chunks")

    def items(todo: Iterator[tuple[str, int, int]]) -> Iterator[dict | tuple[str, int, bytes]]:
        at, f, block = None, None, HEADER_BLOCK
        try:
            for path, size, n in todo:
                if path != at:
                    if f is not None:
                        f.close()
                    fs, inner = winlog._open(path)
                    at, f = path, fs.open_input_file(inner)
                    try:
                        block = file_header(f.read_at(128, 0))["header_block_size"] or HEADER_BLOCK
                    except DecodeError as e:
                        block = None
                        yield {"file": path, "error": error(e)}
                if block is None:
                    continue
                data = f.read_at(CHUNK, block + n * CHUNK) if block + (n + 1) * CHUNK <= size else b""
                if len(data) == CHUNK and data.count(0) != CHUNK:
                    yield path, n, data
        finally:
            if f is not None:
                f.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = (c for b in batches for c in zip(*(b.column(k).to_pylist() for k in ("file", "size", "chunk_no")), strict=True))
        yield from winlog.decoded(items(todo), winlog.with_templates(o), winlog.VIEWS[o.view])

    n = tasks or chunks.sparkSession.sparkContext.defaultParallelism * 4
    return chunks.select("file", "size", "chunk_no").repartitionByRange(n, "file", "chunk_no").sortWithinPartitions("file", "chunk_no").mapInArrow(run, winlog.VIEWS[o.view])


def states(files: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Index rows of all chunks of files (file, size, modified); an empty chunk has no records."""
    found = scan(places(files), tasks=tasks, view="states").where("error IS NULL")
    whole = places(files).join(found.drop("error"), ["file", "chunk_no"], "left")
    zero = F.lit(0).cast("long")
    return whole.select("file", "size", "modified", "chunk_no", *(F.coalesce(c, zero).alias(c) for c in ("records", "errors", "untimed")), "first_id", "last_id", "first_ts", "last_ts", "facets")


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index at a path; an empty one if nothing has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(index)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path) or not any(s.getPath().getName().endswith(".parquet") for s in files.listStatus(path)):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(index)


def update(spark: SparkSession, path: str, index: str, **where: object) -> int:
    """Index the files whose present version has no rows; gives how many these were. Rows of older
    versions stay and are never met again."""
    files = listing(spark, path, **where)
    known = read_index(spark, index).select("file", "size", "modified").distinct()
    new = files.join(known, ["file", "size", "modified"], "left_anti").collect()  # of the listing, which the driver has made
    if new:
        states(spark.createDataFrame(new, VERSION)).write.mode("append").parquet(index)
    return len(new)


def _has(facet: str, keys: Sequence[object]) -> Column:
    return F.exists("facets", lambda f: (f["facet"] == facet) & f["key"].isin(*(str(k) for k in keys)))


def may_match(filters: Filters = Filters(), ids: Sequence[tuple[int, int]] = ()) -> Column:
    """Whether a chunk of an index row may hold a good record that the filter keeps and whose id
    lies in one of the ranges, if any are given."""
    parts = [F.col("records") > 0]
    for facet, values in (("provider", filters.provider), ("channel", filters.channel), ("level", [int(v) for v in filters.level]), ("event_id", [int(v) for v in filters.event_id])):
        if values:
            parts.append(_has(facet, values))
    if filters.time_range:
        low, high = filters.time_range
        parts += [F.col("last_ts") >= F.lit(low)] if low else []
        parts += [F.col("first_ts") <= F.lit(high)] if high else []
    if ids:
        parts.append(reduce(lambda a, b: a | b, [(F.col("first_id") <= high) & (F.col("last_id") >= low) for low, high in ids]))
    return reduce(lambda a, b: a & b, parts)


def candidates(spark: SparkSession, path: str, index: str, filters: Filters = Filters(), ids: Sequence[tuple[int, int]] = (), **where: object) -> DataFrame:
    """The chunks (file, size, chunk_no) that a filter needs: those that may match, and those that
    the index doesn't know in their present version."""
    now = places(listing(spark, path, **where))
    known = read_index(spark, index).dropDuplicates(["file", "size", "modified", "chunk_no"])
    met = now.join(known, ["file", "size", "modified", "chunk_no"], "left")
    return met.where(F.col("records").isNull() | F.coalesce(may_match(filters, ids), F.lit(False))).select("file", "size", "chunk_no")


def read(spark: SparkSession, path: str, index: str, filters: Filters = Filters(), ids: Sequence[tuple[int, int]] = (), *, columns: Columns = Columns(), recursive: bool = False, extensions: str = "", **options: object) -> DataFrame:
    """Good records that a filter keeps, of the files at a path, by way of an index. The time
    range is that of the records' own time."""
    rows = scan(candidates(spark, path, index, filters, ids, recursive=recursive, extensions=extensions), **options).where("error IS NULL")
    kept = rows.where(filters.condition(columns, F.col("ts")))
    return kept.where(in_ranges(F.col("record_id"), list(ids))) if ids else kept


def facet_counts(spark: SparkSession, path: str, index: str, **where: object) -> DataFrame:
    """(facet, key, cnt) of all records of indexed files, from the index alone. Raises ValueError
    if a file isn't indexed in its present version."""
    files = listing(spark, path, **where)
    known = read_index(spark, index).dropDuplicates(["file", "size", "modified", "chunk_no"])
    if files.join(known, ["file", "size", "modified"], "left_anti").limit(1).count():
        raise ValueError("update the index first: some files have changed or are new")
    return merged(known.join(files, ["file", "size", "modified"], "left_semi"))


def merged(states: DataFrame) -> DataFrame:
    """Facet counts of any index rows added up; a null key is empty text."""
    each = states.select(F.explode("facets").alias("f"))
    return each.groupBy(F.col("f.facet").alias("facet"), F.coalesce("f.key", F.lit("")).alias("key")).agg(F.sum("f.cnt").alias("cnt"))
