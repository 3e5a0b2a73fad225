"""Cached windows: decoded records of a chunk from a start on, kept as Parquet under a byte budget.

A window's key is the file's version (path, size, time of change), the chunk, the start, the limit
and the source's options; a changed file has other keys, so its windows are decoded anew. A chunk is
decoded at most once for a window: one task opens it, and the rows are written to a folder that all
executors share. When the kept windows exceed the budget, those not used for longest go. The list of
windows is a small table of the driver's, read back from the folder when a cache is opened again.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import winlog, zones


@dataclass
class WindowCache:
    """Windows in a folder. ``decoded`` counts the chunks that had to be opened, ``hits`` those that hadn't."""

    spark: SparkSession
    folder: str
    budget: int = 1 << 30
    decoded: int = 0
    hits: int = 0
    kept: OrderedDict[str, int] = field(default_factory=OrderedDict)

    def __post_init__(self) -> None:
        fs, inner = winlog._open(self.folder.rstrip("/"))
        fs.create_dir(inner)
        found = []
        for i in fs.get_file_info(pafs.FileSelector(inner)):
            if i.type == pafs.FileType.Directory:
                files = fs.get_file_info(pafs.FileSelector(i.path))
                done = any(f.base_name == "_SUCCESS" for f in files)
                if done:
                    found.append((max((f.mtime_ns or 0 for f in files), default=0), i.base_name, sum(f.size or 0 for f in files)))
                else:  # a write that never ended
                    fs.delete_dir(i.path)
        self.kept = OrderedDict((name, size) for _, name, size in sorted(found))
        self._trim()

    def window(self, path: str, chunk: int, start: int = 0, limit: int | None = None, **options: object) -> DataFrame:
        """Rows of one chunk from the start-th on, in the view ``records`` and in order, errors among them."""
        fs, inner = winlog._open(path)
        info = fs.get_file_info(inner)
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(path)
        asked = json.dumps([path, info.size, info.mtime_ns, chunk, start, limit, sorted((k, str(v)) for k, v in options.items())])
        key = hashlib.sha256(asked.encode()).hexdigest()
        at = f"{self.folder.rstrip('/')}/{key}"
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
        else:
            self.decoded += 1
            one = self.spark.createDataFrame([(path, info.size, chunk)], "file string, size long, chunk_no int")
            low = (chunk << 32) + start
            rows = zones.scan(one, tasks=1, **options).where(F.col("record_seq") >= low)
            if limit is not None:
                rows = rows.where(F.col("record_seq") < low + limit)
            rows.write.mode("overwrite").parquet(at)
            store, where = winlog._open(at)
            self.kept[key] = sum(f.size or 0 for f in store.get_file_info(pafs.FileSelector(where)))
            self._trim(key)
        return self.spark.read.schema(winlog.VIEWS["records"]).parquet(at).orderBy("record_seq")

    def _trim(self, but: str | None = None) -> None:
        """Drop windows not used for longest until the budget holds; the newest one stays."""
        fs, inner = winlog._open(self.folder.rstrip("/"))
        while sum(self.kept.values()) > self.budget and len(self.kept) > (but is not None):
            key, _ = self.kept.popitem(last=False)
            fs.delete_dir(f"{inner}/{key}")
