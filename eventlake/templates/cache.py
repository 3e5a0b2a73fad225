"""The template cache file, and the lookup of a provider's template by GUID."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from ..binxml.values import DecodeError, need
from .manifest import parse

MAGIC, VERSION, CRIM = b"WEVTCACH", 1, 1


def header(n: int) -> bytes:
    """What a cache file of n entries begins with."""
    return MAGIC + struct.pack("<II", VERSION, n)


def entry(blob: bytes) -> bytes:
    return struct.pack("<BQ", CRIM, len(blob)) + blob


def write(blobs: Iterable[bytes]) -> bytes:
    blobs = list(blobs)
    return header(len(blobs)) + b"".join(map(entry, blobs))


def read(data: bytes) -> Iterator[bytes]:
    """The manifests of a cache file; entries of other kinds are skipped."""
    need(data, 0, 16, "cache header")
    if data[:8] != MAGIC:
        raise DecodeError("InvalidCache", f"cache magic is {data[:8]!r}")
    version, n = struct.unpack_from("<II", data, 8)
    if version != VERSION:
        raise DecodeError("InvalidCache", f"cache version {version}")
    at = 16
    for _ in range(n):
        need(data, at, 9, "cache entry")
        kind, size = struct.unpack_from("<BQ", data, at)
        need(data, at + 9, size, "cache entry")
        if kind == CRIM:
            yield bytes(data[at + 9 : at + 9 + size])
        at += 9 + size


def normalise(guid: str) -> str:
    return guid.strip().strip("{}").lower()


class TemplateCache:
    """Templates by GUID (the first source wins) and by event (the last insert wins)."""

    def __init__(self, blobs: Iterable[bytes] = ()):
        self.bodies: dict[str, bytes] = {}
        self.items: dict[str, list[dict]] = {}
        self.by_event: dict[tuple[str, int, int], str] = {}
        for blob in blobs:
            self.add(blob)

    def add(self, blob: bytes) -> None:
        for p in parse(blob)["providers"]:
            places = {}
            for t in p["templates"]:
                guid = normalise(t["guid"])
                places.setdefault(t["offset"], guid)
                if guid not in self.bodies:
                    self.bodies[guid], self.items[guid] = t["body"], t["items"]
            for e in p["events"]:
                guid = places.get(e["template_offset"])
                if guid:
                    self.by_event[normalise(p["guid"]), e["identifier"], e["version"]] = guid

    def body(self, guid: str) -> bytes | None:
        return self.bodies.get(normalise(guid))

    def resolve(self, provider: str, event_id: int, version: int) -> str | None:
        return self.by_event.get((normalise(provider), event_id, version))


@lru_cache(maxsize=4)
def load(path: str) -> TemplateCache:
    """A cache file's templates, read once in a worker."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(inner) as f:
        return TemplateCache(read(f.readall()))


def blobs(files: DataFrame, *, content: str = "content", path: str = "path") -> DataFrame:
    """(path, content) rows of the manifests in a BINARY column of cache files."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                for found in read(batch.column(content)[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(path)[i].as_py()], pa.string()), pa.array([found], pa.binary())], ["path", "content"])

    return files.select(path, content).mapInArrow(run, "path string, content binary")


@udtf(returnType="entry int, blob binary")
class CacheBlobs:
    """Table function (content) to (entry, blob): the manifests of a cache file, for lateral joins
    in SQL. A null gives no rows, damage an error."""

    def eval(self, content: bytes) -> Iterator[tuple[int, bytes]]:
        if content is not None:
            yield from enumerate(read(bytes(content)))


def twice(blob: bytes) -> bytes:
    """A cache file with two entries of a manifest, for fixtures."""
    return write([blob, blob])
