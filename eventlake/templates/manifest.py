"""Provider manifests (CRIM): providers with their tables of definitions.

``parse`` gives nested plain dicts, ready for Arrow; ``SCHEMA`` is their Spark type, and
the functions at the end are relations over a column of blobs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..binxml.values import DecodeError, guid_text, need, utf16

NO_MESSAGE = 0xFFFFFFFF
EVENT_KEY = ("provider", "identifier", "version", "channel", "level", "opcode", "task", "keywords")

#: Tables of fixed-size rows: fields by (name, offset, struct code); ``name`` of an offset field is a sized text.
TABLES = {
    b"CHAN": ("channels", 16, (("identifier", 0, "I"), ("name_offset", 4, "I"), ("unknown", 8, "I"), ("message_id", 12, "I")), "name_offset"),
    b"KEYW": ("keywords", 16, (("identifier", 0, "Q"), ("message_id", 8, "I"), ("name_offset", 12, "I")), "name_offset"),
    b"LEVL": ("levels", 12, (("identifier", 0, "I"), ("message_id", 4, "I"), ("name_offset", 8, "I")), "name_offset"),
    b"OPCO": ("opcodes", 12, (("identifier", 0, "I"), ("message_id", 4, "I"), ("name_offset", 8, "I")), "name_offset"),
    b"TASK": ("tasks", 28, (("identifier", 0, "I"), ("message_id", 4, "I"), ("mui_guid", 8, "16s"), ("name_offset", 24, "I")), "name_offset"),
}
EVENT_FIELDS = (("identifier", 0, "H"), ("version", 2, "B"), ("channel", 3, "B"), ("level", 4, "B"), ("opcode", 5, "B"), ("task", 6, "H"), ("keywords", 8, "Q"), ("message_id", 16, "I"), ("template_offset", 20, "I"), ("opcode_offset", 24, "I"), ("level_offset", 28, "I"), ("task_offset", 32, "I"), ("unknown_count", 36, "I"), ("unknown_offset", 40, "I"), ("flags", 44, "I"))
ITEM_FIELDS = (("unknown1", 0, "I"), ("input_type", 4, "B"), ("output_type", 5, "B"), ("unknown3", 6, "H"), ("unknown4", 8, "I"), ("count", 12, "H"), ("length", 14, "H"), ("name_offset", 16, "I"))


def _fields(fields: tuple, data: bytes, at: int) -> dict:
    row = {name: struct.unpack_from("<" + code, data, at + place)[0] for name, place, code in fields}
    if row.get("message_id") == NO_MESSAGE:
        row["message_id"] = None
    return row


def _u32(data: bytes, at: int, what: str) -> int:
    need(data, at, 4, what)
    return struct.unpack_from("<I", data, at)[0]


def _signature(data: bytes, at: int, expected: bytes) -> None:
    need(data, at, 4, expected.decode())
    if data[at : at + 4] != expected:
        raise DecodeError("InvalidSignature", f"expected {expected!r}, found {bytes(data[at : at + 4])!r}", at)


def sized_text(data: bytes, at: int, what: str) -> str | None:
    """A text after its size in bytes (the size counts itself); none at offset 0."""
    if not at:
        return None
    size = _u32(data, at, what)
    if size < 4 or (size - 4) % 2:
        raise DecodeError("SizeOutOfBounds", f"{what}: size {size}", at)
    need(data, at + 4, size - 4, what)
    return utf16(bytes(data[at + 4 : at + size]))


def _bounds(data: bytes, at: int, sig: bytes, head: int, row: int) -> tuple[int, int, int]:
    """(number of rows, where they start, the table's end). A size of 0 is as large as the rows need."""
    _signature(data, at, sig)
    need(data, at, head, sig.decode())
    size, n = struct.unpack_from("<II", data, at + 4)
    stop = at + head + n * row
    if size == 0:
        need(data, at + head, n * row, f"{sig.decode()} rows")
        return n, at + head, stop
    if size < head or at + size > len(data):
        raise DecodeError("SizeOutOfBounds", f"{sig.decode()}.size {size}", at)
    if stop > at + size:
        raise DecodeError("SizeOutOfBounds", f"{sig.decode()}: {n} rows don't fit in {size} bytes", at)
    return n, at + head, at + size


def _table(data: bytes, at: int, sig: bytes) -> list[dict]:
    _, size, fields, text = TABLES[sig]
    n, first, _ = _bounds(data, at, sig, 12, size)
    out = []
    for i in range(n):
        row = _fields(fields, data, first + i * size)
        row["name"] = sized_text(data, row[text], f"{sig.decode()} name")
        if "mui_guid" in row:
            row["mui_guid"] = guid_text(row["mui_guid"])
        out.append(row)
    return out


def _events(data: bytes, at: int) -> list[dict]:
    n, first, _ = _bounds(data, at, b"EVNT", 16, 48)
    out = []
    for i in range(n):
        row = _fields(EVENT_FIELDS, data, first + 48 * i)
        out.append({k: (v or None) if k.endswith("_offset") and k != "unknown_offset" else v for k, v in row.items()})
    return out


def _templates(data: bytes, at: int) -> list[dict]:
    _signature(data, at, b"TTBL")
    need(data, at, 12, "TTBL")
    size, n = struct.unpack_from("<II", data, at + 4)
    if size < 12 or at + size > len(data):
        raise DecodeError("SizeOutOfBounds", f"TTBL.size {size}", at)
    end, now, out = at + size, at + 12, []
    for _ in range(n):
        if now + 40 > end:
            raise DecodeError("Truncated", "TEMP header", now)
        _signature(data, now, b"TEMP")
        temp, items, names, items_at, event_type = struct.unpack_from("<IIIII", data, now + 4)
        if temp < 40 or now + temp > end:
            raise DecodeError("SizeOutOfBounds", f"TEMP.size {temp}", now)
        if not items and names:
            raise DecodeError("CountOutOfBounds", "TEMP has names but no items", now)
        stop = now + temp if not items_at else items_at
        if not now <= stop <= now + temp or items and not now + 40 <= stop < now + temp:
            raise DecodeError("OffsetOutOfBounds", f"TEMP.template_items_offset {items_at}", now)
        if not items and items_at and stop != now + temp:
            raise DecodeError("OffsetOutOfBounds", f"TEMP.template_items_offset {items_at} without items", now)
        out.append({"offset": now, "guid": guid_text(bytes(data[now + 24 : now + 40])), "event_type": event_type, "body": bytes(data[now + 40 : max(now + 40, stop)]), "items": _items(data, stop, items, now, now + temp)})
        now += temp
    return out


def _items(data: bytes, at: int, n: int, low: int, end: int) -> list[dict]:
    if at + 20 * n > end:
        raise DecodeError("Truncated", "template items", at)
    out = []
    for i in range(n):
        row = _fields(ITEM_FIELDS, data, at + 20 * i)
        name = row["name_offset"]
        if name and not at + 20 * n <= name < end:
            raise DecodeError("OffsetOutOfBounds", f"template item name_offset {name}", low)
        row["name"] = sized_text(data[:end], name, "template item name")
        out.append(row)
    return out


def _maps(data: bytes, at: int) -> list[dict]:
    _signature(data, at, b"MAPS")
    need(data, at, 16, "MAPS")
    size, n = struct.unpack_from("<II", data, at + 4)
    if size < 16 or at + size > len(data):
        raise DecodeError("SizeOutOfBounds", f"MAPS.size {size}", at)
    if not n:
        return []
    # The first map follows the offsets of the others.
    need(data, at + 16, 4 * (n - 1), "MAPS offsets")
    places = [at + 16 + 4 * (n - 1), *struct.unpack_from(f"<{n - 1}I", data, at + 16)]
    out = []
    for place in places:
        need(data, place, 4, "map")
        kind = bytes(data[place : place + 4])
        row: dict = {"offset": place, "kind": kind.decode("latin-1"), "name": None, "entries": []}
        if kind == b"VMAP":
            need(data, place, 16, "VMAP")
            length, text, entries = struct.unpack_from("<III", data, place + 4)
            if length < 16 + 8 * entries or place + length > at + size:
                raise DecodeError("SizeOutOfBounds", f"VMAP.size {length}", place)
            row["name"] = sized_text(data, text, "VMAP name")
            for i in range(entries):
                value, message = struct.unpack_from("<II", data, place + 16 + 8 * i)
                row["entries"].append({"identifier": value, "message_id": None if message == NO_MESSAGE else message})
        out.append(row)
    return out


def parse(blob: bytes) -> dict:
    """{size, major, minor, providers: [...]}; DecodeError with the place of the damage."""
    _signature(blob, 0, b"CRIM")
    need(blob, 0, 16, "CRIM")
    size, major, minor, n = struct.unpack_from("<IHHI", blob, 4)
    if size < 16 or size > len(blob):
        raise DecodeError("SizeOutOfBounds", f"CRIM.size {size}")
    data = blob[:size]
    need(data, 16, 20 * n, "CRIM providers")
    return {"size": size, "major": major, "minor": minor, "providers": [_provider(data, 16 + 20 * i) for i in range(n)]}


def _provider(data: bytes, at: int) -> dict:
    guid, place = guid_text(bytes(data[at : at + 16])), _u32(data, at + 16, "provider offset")
    _signature(data, place, b"WEVT")
    need(data, place, 20, "WEVT")
    size, message, n, others = struct.unpack_from("<IIII", data, place + 4)
    need(data, place + 20, 8 * n + 4 * others, "WEVT descriptors")
    out: dict = {"guid": guid, "offset": place, "message_id": None if message == NO_MESSAGE else message, **{t[0]: [] for t in TABLES.values()}, "events": [], "templates": [], "maps": [], "unknown": []}
    for i in range(n):
        where = _u32(data, place + 20 + 8 * i, "element offset")
        need(data, where, 4, "element signature")
        sig = bytes(data[where : where + 4])
        if sig in TABLES:
            out[TABLES[sig][0]] = _table(data, where, sig)
        elif sig == b"EVNT":
            out["events"] = _events(data, where)
        elif sig == b"TTBL":
            out["templates"] = _templates(data, where)
        elif sig == b"MAPS":
            out["maps"] = _maps(data, where)
        else:
            length = _u32(data, where + 4, "unknown element size")
            need(data, where, length, "unknown element")
            out["unknown"].append({"signature": sig.decode("latin-1"), "offset": where, "size": length})
    return out


# Relations

_L, _S = T.LongType(), T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_ROW = lambda fields, *more: _struct(*((n, _S if c == "16s" else T.DecimalType(20, 0) if c == "Q" else _L) for n, _, c in fields), *more)
_TEMPLATE = _struct(("offset", _L), ("guid", _S), ("event_type", _L), ("body", T.BinaryType()), ("items", T.ArrayType(_ROW(ITEM_FIELDS, ("name", _S)))))
_MAP = _struct(("offset", _L), ("kind", _S), ("name", _S), ("entries", T.ArrayType(_struct(("identifier", _L), ("message_id", _L)))))
PROVIDER = _struct(
    ("guid", _S),
    ("offset", _L),
    ("message_id", _L),
    *((t[0], T.ArrayType(_ROW(t[2], ("name", _S)))) for t in TABLES.values()),
    ("events", T.ArrayType(_ROW(EVENT_FIELDS))),
    ("templates", T.ArrayType(_TEMPLATE)),
    ("maps", T.ArrayType(_MAP)),
    ("unknown", T.ArrayType(_struct(("signature", _S), ("offset", _L), ("size", _L)))),
)
SCHEMA = _struct(("source", _S), ("resource", _S), ("language", _L), ("blob", T.BinaryType()), ("major", _L), ("minor", _L), ("providers", T.ArrayType(PROVIDER)), ("error", _struct(("code", _S), ("message", _S), ("offset", _L))))


def _decimals(x: object) -> object:
    """Unsigned 64-bit fields as decimals."""
    from decimal import Decimal

    if isinstance(x, dict):
        return {k: Decimal(v) if k == "keywords" and isinstance(v, int) else _decimals(v) for k, v in x.items()}
    return [_decimals(i) for i in x] if isinstance(x, list) else x


def manifests(files: DataFrame, *, content: str = "content", path: str = "path") -> DataFrame:
    """A row for each manifest in a BINARY column of executables, cache files or bare CRIM blobs; damage is in ``error``.
    Files are opened one after another: a worker holds one manifest's definitions at a time."""
    from decimal import Decimal

    from . import cache
    from .pe import resources

    arrow = to_arrow_schema(SCHEMA)

    def row(source: str, resource: str | None, language: int, blob: bytes) -> dict:
        try:
            made = parse(blob)
        except DecodeError as e:
            return {"source": source, "resource": resource, "language": language, "blob": blob, "error": {"code": e.code, "message": e.message, "offset": e.offset}}
        for p in made["providers"]:
            for k in p["keywords"]:
                k["identifier"] = Decimal(k["identifier"])
            for e in p["events"]:
                e["keywords"] = Decimal(e["keywords"])
        return {"source": source, "resource": resource, "language": language, "blob": blob, "major": made["major"], "minor": made["minor"], "providers": made["providers"]}

    def opened(data: bytes) -> Iterable[tuple[str | None, int, bytes]]:
        if data[:4] == b"CRIM":
            return [(None, 0, data)]
        return ((None, 0, blob) for blob in cache.read(data)) if data[:8] == cache.MAGIC else list(resources(data))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, data in ((batch.column(path)[i].as_py(), batch.column(content)[i].as_py()) for batch in it for i in range(batch.num_rows)):
            try:
                for resource, language, blob in opened(data):
                    yield pa.RecordBatch.from_pylist([row(source, resource, language, blob)], arrow)
            except DecodeError as e:
                yield pa.RecordBatch.from_pylist([{"source": source, "error": {"code": e.code, "message": e.message, "offset": e.offset}}], arrow)

    return files.select(path, content).mapInArrow(run, SCHEMA)


def providers(found: DataFrame) -> DataFrame:
    return found.where("error IS NULL").select("source", F.explode("providers").alias("p")).select("source", "p.*")


def table(found: DataFrame, name: str) -> DataFrame:
    """One of channels, keywords, levels, opcodes, tasks, events, templates, maps with its provider."""
    p = providers(found)
    return p.select("source", F.col("guid").alias("provider"), F.explode(name).alias("row_")).select("source", "provider", "row_.*")


def event_templates(found: DataFrame) -> DataFrame:
    """Events joined with their template by offset: the template's guid, or null. An offset is a place
    in its manifest, and a source may have several of a provider, so the manifest is part of the key."""
    keys = ["source", "manifest_", "provider", "template_offset"]
    each = found.where("error IS NULL").select("source", F.md5("blob").alias("manifest_"), F.explode("providers").alias("p")).select("source", "manifest_", F.col("p.guid").alias("provider"), "p.events", "p.templates")
    events = each.select("source", "manifest_", "provider", F.explode("events").alias("row_")).select("source", "manifest_", "provider", "row_.*")
    known = each.select("source", "manifest_", "provider", F.explode("templates").alias("t")).select("source", "manifest_", "provider", F.col("t.offset").alias("template_offset"), F.col("t.guid").alias("template_guid"))
    return events.join(known.dropDuplicates(keys), keys, "left").drop("manifest_")


def event_index(found: DataFrame) -> DataFrame:
    """Distinct template GUIDs of each event key."""
    return event_templates(found).where("template_guid IS NOT NULL").groupBy(*EVENT_KEY).agg(F.array_sort(F.collect_set("template_guid")).alias("template_guids"))


def stats(found: DataFrame, *, parts: bool = False) -> DataFrame:
    """Counts of providers and definitions by source. ``parts``: a source's manifests are parts of one, each with
    events of its own, so what several of them define alike for a provider counts once."""
    names = ("templates", "events", "maps", "channels", "levels", "opcodes", "tasks", "keywords")
    if not parts:
        return providers(found).groupBy("source").agg(F.count("*").alias("providers"), *[F.sum(F.size(n)).alias(n) for n in names])

    def item(kind: str, key: Column, n: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), (F.lit(1) if n is None else n).cast("long").alias("n"))

    def alike(kind: str) -> Column:
        keys = {"templates": lambda x: x["guid"], "maps": lambda x: F.to_json(x.dropFields("offset"))}
        return F.transform(kind, lambda x: item(kind, keys.get(kind, lambda x: x["identifier"])(x)))

    each = found.where("error IS NULL").select("source", F.md5("blob").alias("manifest_"), F.explode("providers").alias("p")).select("source", "manifest_", "p.*")
    one = F.array(item("providers", F.lit("")), item("events", F.col("manifest_"), F.size("events")))
    counted = each.select("source", "guid", F.inline(F.concat(one, *[alike(n) for n in names if n != "events"]))).groupBy("source", "guid", "kind", "key").agg(F.max("n").alias("n"))
    return counted.groupBy("source").agg(*[F.sum(F.when(F.col("kind") == n, F.col("n")).otherwise(0)).alias(n) for n in ("providers", *names)])
