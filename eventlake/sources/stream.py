"""Log files as a stream of records: offsets are places inside of files.

A file's offset is (chunk, records of it): all chunks before are done, and so many records of
that one. So a file that grows, inside of its last chunk or by chunks, gives each record once,
a restart goes on in the middle of a file, and a large file is many tasks. Looking for news
reads the last chunk's header of each file; the offsets are one small entry a file.

A record is told by its place, so a file must only grow: one that shrinks, or whose chunks
are written over, is to be read as a new file under another name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..binxml.reader import CHUNK, CHUNK_MAGIC, HEADER_BLOCK, chunk_places, error, file_header
from ..binxml.values import DecodeError


@dataclass
class Piece(InputPartition):
    """Chunks from ``first`` to before ``stop`` of a file, without the first ``skip`` records of
    the first one, and without those from ``until`` on of the last one (None: all)."""

    path: str
    first: int
    stop: int
    skip: int
    until: int | None


def reached(read, size: int) -> tuple[int, int]:
    """(chunk, records) up to which a file is filled. Room that a log has taken in advance is empty."""
    head = file_header(read(0, 128))
    block = head["header_block_size"] or HEADER_BLOCK
    places = chunk_places(size, block)

    def records(n: int) -> int:
        h = read(block + n * CHUNK, 512)
        if h[:8] != CHUNK_MAGIC:
            return 1 if h.count(0) != len(h) else 0  # a damaged chunk is one error row
        first, last = struct.unpack_from("<QQ", h, 8)
        return max(0, min(last - first + 1, CHUNK))

    # A log that was closed well says how many chunks it has; else the last chunk in use is looked for from the end.
    n = places
    said = head["chunk_count"]
    if 0 < said < places and not records(said):
        n = said
    while n and not records(n - 1):
        n -= 1
    return (n - 1, records(n - 1)) if n else (0, 0)


def pieces(path: str, start: tuple[int, int], end: tuple[int, int], step: int) -> list[Piece]:
    """The tasks between two offsets of a file, of ``step`` chunks at most."""
    (a, skip), (b, until) = start, end
    if (b, until) <= (a, skip):
        return []
    out = []
    for at in range(a, b + 1, step):
        stop = min(at + step, b + 1)
        out.append(Piece(path, at, stop, skip if at == a else 0, until if stop == b + 1 else None))
    return out


class WinlogStreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, paths: list[str], options):
        if options.view not in ("records", "record_headers"):
            raise ValueError("a stream has the view records or record_headers")
        self.schema, self.paths, self.options = schema, paths, options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from .winlog import _open, expand_paths

        found = {}
        for path, size in expand_paths(self.paths, recursive=self.options.recursive, extensions=self.options.extensions):
            fs, inner = _open(path)
            with fs.open_input_file(inner) as f:
                try:
                    found[path] = list(reached(lambda at, n: f.read_at(n, at), size))  # noqa: B023
                except DecodeError:
                    found[path] = [0, 1]  # not a log, or not one yet: one error row
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from .winlog import PER_TASK, packed

        step = self.options.chunks_per_partition or PER_TASK
        found = [p for path, place in sorted(end.items()) for p in pieces(path, tuple(start.get(path, (0, 0))), tuple(place), step)]
        return packed(found, max(PER_TASK, step) if self.options.packed else 0)

    def _items(self, part: Piece, o) -> Iterator[dict | tuple[str, int, bytes]]:
        """Whole chunks, and the rows of those that the task has a part of."""
        from .winlog import _open, rows_of_chunk, wanted

        fs, inner = _open(part.path)
        with fs.open_input_file(inner) as f:
            try:
                block = file_header(f.read_at(128, 0))["header_block_size"] or HEADER_BLOCK
            except DecodeError as e:
                yield {"file": part.path, "error": error(e)}
                return
            for n in range(part.first, part.stop):
                data = f.read_at(CHUNK, block + n * CHUNK)
                if len(data) < CHUNK or data.count(0) == CHUNK:
                    continue
                low = part.skip if n == part.first else 0
                high = part.until if n == part.stop - 1 and part.until is not None else 1 << 62
                if not low and high == 1 << 62:
                    yield part.path, n, data
                    continue
                for k, row in enumerate(rows_of_chunk(part.path, n, data, o)):
                    # An error that ends a chunk comes after its last record, and goes with it.
                    if low <= k < high or k == high and row.get("error") and row.get("record_id") is None:
                        yield from wanted(iter([row]), o)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from .winlog import decoded, with_templates

        o = with_templates(self.options)
        if o.limit is None:
            yield from decoded((item for part in partition.ranges for item in self._items(part, o)), o, self.schema)
            return
        for part in partition.ranges:
            yield from decoded(self._items(part, o), o, self.schema)

    def commit(self, end: dict) -> None: ...

    def stop(self) -> None: ...
