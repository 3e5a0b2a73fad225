"""Counting, paging and exporting the logs table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .columns import ColumnSpec, Columns, shown
from .filters import Filters

PAGE = 4000
#: Rows up to which a page is cut from the sorted rows at once, and ranges counted for a later one.
DIRECT, RANGES = 10_000, 4096


def matching(logs: DataFrame, filters: Filters = Filters(), columns: Columns = Columns()) -> DataFrame:
    data = F.col("event_data") if "event_data" in logs.columns and isinstance(logs.schema["event_data"].dataType, MapType) else None
    return logs.where(filters.condition(columns, F.col("ts") if "ts" in logs.columns else None, data))


def count_records(logs: DataFrame, filters: Filters = Filters(), columns: Columns = Columns()) -> DataFrame:
    return matching(logs, filters, columns).agg(F.count("*").alias("cnt"))


def _narrowed(df: DataFrame, limit: int, offset: int, ranges: int) -> tuple[DataFrame, int]:
    """The rows of the ranges of ``record_seq`` that a page lies in, and the offset among them."""
    seen = df.agg(F.min("record_seq").alias("low"), F.max("record_seq").alias("high"), F.count_if(F.col("record_seq").isNull()).alias("nulls")).first()
    if offset < seen["nulls"]:
        return df, offset
    df, offset, low, high = df.where("record_seq IS NOT NULL"), offset - seen["nulls"], seen["low"], seen["high"]
    if low is None:
        return df, 0
    while True:
        width = (high - low) // ranges + 1
        inside = df.where(F.col("record_seq").between(low, high))
        counts = inside.groupBy(F.expr(f"(record_seq - {low}L) div {width}L").alias("slot")).count().orderBy("slot").collect()
        before, hit = 0, []
        for slot, n in counts:
            if before + n > offset and before < offset + limit:
                hit.append((slot, n, before))
            before += n
        if not hit:
            return df.limit(0), 0
        offset -= hit[0][2]
        low, high = low + hit[0][0] * width, min(high, low + (hit[-1][0] + 1) * width - 1)
        if width == 1 or sum(n for _, n, _ in hit) <= 2 * (offset + limit) or len(hit) == len(counts) > 1:
            return df.where(F.col("record_seq").between(low, high)), offset


def _of_files(df: DataFrame, limit: int, offset: int) -> tuple[DataFrame, int, bool]:
    """The rows of the files that a page lies in, the offset among them, and whether it's one file."""
    sizes = df.groupBy("file").agg(F.count("*").alias("n"))
    ends = sizes.select("file", "n", F.sum("n").over(Window.orderBy(F.col("file").asc_nulls_first())).alias("end"))  # a row for each file
    hit = ends.where((F.col("end") > offset) & (F.col("end") - F.col("n") < offset + limit))
    found = hit.agg(F.min("file").alias("low"), F.max("file").alias("high"), F.min(F.col("end") - F.col("n")).alias("before"), F.count_if(F.col("file").isNull()).alias("nulls"), F.count("*").alias("files")).first()
    if not found["files"]:
        return df.limit(0), 0, False
    inside = F.col("file").between(found["low"], found["high"]) if found["low"] is not None else F.lit(False)
    return df.where(inside | F.col("file").isNull() if found["nulls"] else inside), offset - found["before"], found["files"] == 1


def record_order(df: DataFrame) -> list[str]:
    """The columns of record order: the file, if the rows have one, and the place in it."""
    return ["file", "record_seq"] if "file" in df.columns else ["record_seq"]


def paged(df: DataFrame, limit: int | None, offset: int = 0, *, direct: int = DIRECT, ranges: int = RANGES) -> DataFrame:
    """A page in record order: sorted by ``file`` where rows have one, then by ``record_seq`` (nulls
    first). That order is total over decoded rows, so pages meet and miss nothing.

    A page within the first ``direct`` rows is cut from the sorted rows. For a later one rows are
    counted by file, and in the file that it lies in by ``ranges`` ranges of ``record_seq``, again
    within those that the page lies in as long as that helps; only their rows are sorted, so that
    a late page costs no more than an early one.
    """
    order = record_order(df)
    if offset and limit is not None and offset + limit > direct:
        one = True
        if len(order) > 1:
            df, offset, one = _of_files(df, limit, offset)
        if one:
            df, offset = _narrowed(df, limit, offset, ranges)
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def fetch_tabular(logs: DataFrame, specs: Sequence[ColumnSpec], filters: Filters = Filters(), *, limit: int | None = PAGE, offset: int = 0, columns: Columns = Columns()) -> DataFrame:
    """The columns and Raw of a page. The page is cut before the JSON paths are read."""
    page = paged(matching(logs, filters, columns), limit, offset)
    return shown(page, specs, "Raw")


def fetch_records(logs: DataFrame, filters: Filters = Filters(), *, limit: int | None = None, offset: int = 0, columns: Columns = Columns()) -> DataFrame:
    """Raw of a page, without rows that aren't JSON."""
    return paged(matching(logs, filters, columns), limit, offset).where(F.try_parse_json("Raw").isNotNull()).select("Raw")


def page_count(total: int, page: int = PAGE) -> int:
    return math.ceil(total / page)


def record_by_id(records: DataFrame, record_id: int) -> DataFrame:
    return records.where(F.col("record_id") == record_id).limit(1)


def chunk_window(records: DataFrame, chunk: int, start: int = 0, limit: int | None = None, *, chunk_column: str = "chunk_no") -> DataFrame:
    """Records of one chunk (of each file, if there are several) from the start-th on, in order; one task sorts one chunk."""
    rows = records.where(F.col(chunk_column) == chunk).withColumn("row_in_chunk", F.row_number().over(Window.partitionBy(*record_order(records)[:-1], chunk_column).orderBy("record_seq")) - 1)
    rows = rows.where(F.col("row_in_chunk") >= start)
    return rows if limit is None else rows.where(F.col("row_in_chunk") < start + limit)


def chunk_info(records: DataFrame, *, chunk_column: str = "chunk_no", id_column: str = "record_id") -> DataFrame:
    """First and last id and record count of each chunk."""
    return records.groupBy(chunk_column).agg(F.min(id_column).alias("first_record_id"), F.max(id_column).alias("last_record_id")).withColumn("record_count", F.greatest(F.col("last_record_id") - F.col("first_record_id") + 1, F.lit(0).cast("long")))


def export_json(logs: DataFrame, path: str, filters: Filters = Filters(), columns: Columns = Columns(), *, ordered: bool = False) -> None:
    """All matching records as JSON lines. Each task writes its own rows, in order within a part
    file; ``ordered`` sorts across part files too, which moves all rows."""
    rows = matching(logs, filters, columns).where(F.try_parse_json("Raw").isNotNull())
    (rows.orderBy(*record_order(rows)) if ordered else rows.sortWithinPartitions(*record_order(rows))).select("Raw").write.text(path)
