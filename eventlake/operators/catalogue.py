"""The file catalogue as a table of versions: each change is a commit, and none is lost.

A version is a Parquet folder and an entry of the log that names it. A commit reads the newest
version, writes what becomes of it to a folder of its own, and creates the next log entry; the
creation fails if another writer was first, and the change is then made again on that
writer's version. Readers see whole versions only. Creating an entry only where there is none is
atomic on stores that can do so (HDFS, local disks).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


class Conflict(RuntimeError):
    """Too many other commits came first."""


@dataclass(frozen=True)
class Catalogue:
    spark: SparkSession
    folder: str

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def version(self) -> int:
        """The newest version's number; 0 before the first commit."""
        path, files = self._path("_log")
        return max((int(s.getPath().getName()) for s in files.listStatus(path)), default=0) if files.exists(path) else 0

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows (``tables.FILE_CATALOGUE``), by default the newest's."""
        n = self.version() if version is None else version
        if not n:
            return self.spark.createDataFrame([], tables.FILE_CATALOGUE)
        path, files = self._path(f"_log/{n:012d}")
        stream = files.open(path)
        try:
            name = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return self.spark.read.schema(tables.FILE_CATALOGUE).parquet(f"{self.folder.rstrip('/')}/{name}")

    def _created(self, n: int, text: str) -> bool:
        """Write the n-th log entry unless there is one."""
        path, files = self._path(f"_log/{n:012d}")
        files.mkdirs(path.getParent())
        if files.getUri().getScheme() == "file":
            try:
                # The entry appears with its content: it's linked when written.
                local = path.toUri().getPath()
                made = f"{local}.{uuid.uuid4().hex}"
                hidden = os.path.join(os.path.dirname(os.path.dirname(made)), "_" + os.path.basename(made))
                with open(hidden, "w") as f:
                    f.write(text)
                try:
                    os.link(hidden, local)
                finally:
                    os.unlink(hidden)
                return True
            except FileExistsError:
                return False
        try:
            stream = files.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def commit(self, change: Callable[[DataFrame], DataFrame], *, tries: int = 20) -> int:
        """Make a change to the newest version; gives the new version's number."""
        for _ in range(tries):
            n = self.version()
            name = f"data-{uuid.uuid4().hex}"
            change(self.read(n)).select(*[c.split()[0] for c in tables.FILE_CATALOGUE.split(", ")]).write.parquet(f"{self.folder.rstrip('/')}/{name}")
            if self._created(n + 1, name):
                return n + 1
            path, files = self._path(name)
            files.delete(path, True)
        raise Conflict(f"{tries} other commits came first")

    def opened(self, files: DataFrame, *, chunks: Column | None = None) -> int:
        """Files (path, length) that were opened: new ones, and known ones with their pins kept."""
        return self.commit(lambda known: tables.merged_catalogue(known, tables.catalogue_entry(files, chunks=chunks)))

    def pin(self, id: str, on: bool = True) -> int:
        return self.commit(lambda known: tables.pinned(known, id, on))

    def touch(self, id: str) -> int:
        return self.commit(lambda known: known.withColumn("last_opened", F.when(F.col("file_id") == id, F.current_timestamp()).otherwise(F.col("last_opened"))))

    def delete(self, id: str) -> int:
        return self.commit(lambda known: tables.without_file(known, id))
