"""Resources of type WEVT_TEMPLATE in portable executables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..binxml.values import DecodeError, need

TYPE = "WEVT_TEMPLATE"


def _sections(data: bytes) -> tuple[int, list[tuple[int, int, int]]]:
    """(address of the resource directory, [(address, size, file offset)])."""
    need(data, 0, 64, "DOS header")
    if data[:2] != b"MZ":
        raise DecodeError("InvalidPe", "no MZ signature")
    at = struct.unpack_from("<I", data, 60)[0]
    need(data, at, 24, "PE header")
    if data[at : at + 4] != b"PE\0\0":
        raise DecodeError("InvalidPe", "no PE signature", at)
    n, optional = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<H", data, at + 20)[0]
    head = at + 24
    need(data, head, optional, "optional header")
    magic = struct.unpack_from("<H", data, head)[0]
    tables = {0x10B: 96, 0x20B: 112}.get(magic)
    if tables is None:
        raise DecodeError("InvalidPe", f"optional header magic {magic:#x}", head)
    if optional < tables + 24:
        return 0, []
    resources = struct.unpack_from("<I", data, head + tables + 16)[0]
    out = []
    for i in range(n):
        s = head + optional + 40 * i
        need(data, s, 40, "section header")
        virtual, address, raw, offset = struct.unpack_from("<IIII", data, s + 8)
        out.append((address, max(virtual, raw), offset))
    return resources, out


def resources(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(resource id, language, bytes) of each WEVT_TEMPLATE resource; none if there's no resource directory."""
    root, sections = _sections(data)
    if not root:
        return

    def offset_of(address: int) -> int:
        for a, size, offset in sections:
            if a <= address < a + size:
                return address - a + offset
        raise DecodeError("InvalidPe", f"address {address:#x} is in no section")

    base = offset_of(root)

    def entries(at: int) -> Iterator[tuple[int | str, int, bool]]:
        need(data, at, 16, "resource directory")
        named, numbered = struct.unpack_from("<HH", data, at + 12)
        for i in range(named + numbered):
            need(data, at + 16 + 8 * i, 8, "resource entry")
            key, value = struct.unpack_from("<II", data, at + 16 + 8 * i)
            if key & 0x80000000:
                place = base + (key & 0x7FFFFFFF)
                need(data, place, 2, "resource name")
                n = struct.unpack_from("<H", data, place)[0]
                need(data, place + 2, 2 * n, "resource name")
                key = data[place + 2 : place + 2 + 2 * n].decode("utf-16-le", "replace")
            yield key, base + (value & 0x7FFFFFFF), bool(value & 0x80000000)

    for kind, at, deeper in entries(base):
        if kind != TYPE or not deeper:
            continue
        for name, at2, deeper2 in entries(at):
            for language, leaf, _ in entries(at2) if deeper2 else []:
                need(data, leaf, 16, "resource data")
                address, size = struct.unpack_from("<II", data, leaf)
                place = offset_of(address)
                need(data, place, size, "resource data")
                yield str(name), language if isinstance(language, int) else 0, bytes(data[place : place + size])


def manifests_of(files: DataFrame) -> DataFrame:
    """(path, nth, name, language, content, error) of the resources of executables (path, content), as
    ``binaryFile`` gives them; a file that can't be read is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in ((batch.column("path")[i].as_py(), batch.column("content")[i].as_py()) for i in range(batch.num_rows)):
                try:
                    rows = [{"path": path, "nth": k, "name": str(name), "language": language, "content": blob, "error": None} for k, (name, language, blob) in enumerate(resources(data or b""))]
                except DecodeError as e:
                    rows = [{"path": path, "nth": 0, "name": None, "language": None, "content": None, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("nth", pa.int32()), ("name", pa.string()), ("language", pa.int64()), ("content", pa.binary()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, nth int, name string, language long, content binary, error string")
