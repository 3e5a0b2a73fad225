"""The ``winlogdump`` sink: records as XML, JSON or JSON lines, in order, all or nothing.

A task writes what it gets to a part of its own in a staging folder and its error rows to a side
file. The commit checks that the parts of all tasks, taken by task number, are in record order
and don't overlap, then moves them into place: reading the parts by name gives the dump that a
single reader would have made, and nothing was sorted. Rows that were shuffled fail the commit
unless ``ordered`` is false. An abort leaves nothing; parts of attempts that were given up stay in
the staging folder, which goes too. ``_SUCCESS`` holds the counts and is written last.

Input: the source's view ``records`` with ``xml`` or ``json``, or any rows with file, record_seq,
record_id, data and error. Options: ``format`` (xml, json, jsonl), ``banner`` ("Record N" before
each record of xml and json), ``ordered``. The mode is append to a folder that has no dump, or
overwrite.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .winlog import _open

FORMATS = {"xml": "xml", "json": "json", "jsonl": "jsonl"}
ROWS = "file string, record_seq long, record_id long, data string, error struct<code:string,message:string,offset:long>"


@dataclass
class Part(WriterCommitMessage):
    number: int
    names: list[tuple[str, str]]
    records: int
    errors: int
    first: tuple | None
    last: tuple | None
    sorted: bool


class DumpWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, banner: bool, ordered: bool, overwrite: bool):
        self.path, self.kind, self.banner, self.ordered, self.overwrite = path.rstrip("/"), kind, banner, ordered, overwrite
        fs, inner = _open(self.path)
        if not overwrite and any(not i.base_name.startswith("_staging") for i in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))):
            raise ValueError(f"{path} isn't empty; overwrite it or take another folder")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        fs, inner = _open(self.staging)
        fs.create_dir(inner)
        suffix = FORMATS[self.kind]
        names = [(f"{number:06d}-{attempt}.{suffix}", f"part-{number:06d}.{suffix}"), (f"{number:06d}-{attempt}.errors", f"errors-{number:06d}.jsonl")]
        records = errors = 0
        first = last = None
        in_order = True
        out, bad = None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["error"]:
                        errors += 1
                        bad = bad or fs.open_output_stream(f"{inner}/{names[1][0]}")
                        bad.write((json.dumps({k: row[k] for k in ("file", "record_seq", "record_id", "error")}, ensure_ascii=False) + "\n").encode())
                        continue
                    records += 1
                    key = (row["file"] or "", row["record_seq"] if row["record_seq"] is not None else -1)
                    in_order &= last is None or last <= key
                    first, last = first or key, key
                    out = out or fs.open_output_stream(f"{inner}/{names[0][0]}")
                    out.write(self._text(row["record_id"], row["data"] or ""))
        finally:
            for f in (out, bad):
                if f is not None:
                    f.close()
        return Part(number, [n for n, f in zip(names, (out, bad), strict=True) if f is not None], records, errors, first, last, in_order)

    def _text(self, record_id: int | None, data: str) -> bytes:
        end = "" if data.endswith("\n") else "\n"
        return (f"Record {record_id}\n{data}{end}" if self.banner and self.kind != "jsonl" else data + end).encode("utf-8", "surrogatepass")

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        if self.ordered:
            filled = [p for p in parts if p.records]
            if not all(p.sorted for p in filled) or any(a.last > b.first for a, b in zip(filled, filled[1:], strict=False)):
                raise ValueError("rows don't come in record order: write what the source gives, sort, or set ordered to false")
        fs, inner = _open(self.path)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
                if i.base_name.startswith(("part-", "errors-", "_SUCCESS")):
                    fs.delete_file(i.path)
        _, staged = _open(self.staging)
        for p in parts:
            for made, name in p.names:
                fs.move(f"{staged}/{made}", f"{inner}/{name}")
        with fs.open_output_stream(f"{inner}/_SUCCESS") as f:
            f.write(json.dumps({"records": sum(p.records for p in parts), "errors": sum(p.errors for p in parts), "parts": [n for p in parts for _, n in p.names if n.startswith("part-")], "side": [n for p in parts for _, n in p.names if n.startswith("errors-")]}).encode())
        self._clean()

    def abort(self, messages: list[Part | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, staged = _open(self.staging)
        if fs.get_file_info(staged).type == pafs.FileType.Directory:
            fs.delete_dir(staged)


class WinlogDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "winlogdump"

    def writer(self, schema: StructType, overwrite: bool) -> DumpWriter:
        kind = self.options.get("format", "xml").lower()
        if kind not in FORMATS:
            raise ValueError(f"format is xml, json or jsonl; not {kind!r}")
        flag = lambda k, default: str(self.options.get(k, default)).lower() == "true"
        return DumpWriter(self.options["path"], kind, flag("banner", True), flag("ordered", True), overwrite)


def dump_rows(records: DataFrame, kind: str) -> DataFrame:
    """Rows of the view ``records`` in the sink's form."""
    return records.select("file", "record_seq", "record_id", F.col("xml" if kind == "xml" else "Raw").alias("data"), "error")


def write(records: DataFrame, path: str, *, kind: str = "xml", banner: bool = True, ordered: bool = True, overwrite: bool = False) -> None:
    """Dump decoded records (as the source gives them, or filtered) to a folder."""
    records.sparkSession.dataSource.register(WinlogDump)
    writer = dump_rows(records, kind).write.format("winlogdump").option("format", kind).option("banner", str(banner).lower()).option("ordered", str(ordered).lower())
    writer.mode("overwrite" if overwrite else "append").save(path)


def parts(path: str) -> list[str]:
    """The parts of a finished dump in order; FileNotFoundError if there's no finished one."""
    return [f"{path.rstrip('/')}/{n}" for n in summary(path)["parts"]]


def summary(path: str) -> dict:
    """What ``_SUCCESS`` says of a finished dump: records, errors, parts, side files."""
    fs, inner = _open(path.rstrip("/"))
    with fs.open_input_file(f"{inner}/_SUCCESS") as f:
        return json.loads(f.read())


def text(spark: SparkSession, path: str) -> DataFrame:
    """(part, nth, value) of a finished dump's lines; by part and ``nth`` they're in record order."""
    rows = spark.read.text(f"{path.rstrip('/')}/part-*").select(F.col("_metadata.file_name").alias("part"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("nth"), "value")
    return rows.select("part", "nth", "value")


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_seq, record_id, error) of a finished dump's error rows."""
    schema = StructType([f for f in spark.createDataFrame([], ROWS).schema.fields if f.name != "data"])
    if not summary(path)["errors"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{n}" for n in summary(path)["side"]])
