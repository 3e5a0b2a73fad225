"""Log files: header, 64 KiB chunks, records. Damage becomes error rows, not exceptions."""

from __future__ import annotations

import json as codec
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

from .quick import column_slots, columns_of, json_of, slots, system_columns, xml_of
from .program import Program, compiled, json_texts, shape_of, xml_texts
from .render import parsed, to_json, to_xml, type_of
from .tree import Decoder, Element, Instance, name_entry
from .values import DecodeError, filetime, guid_text

HEADER_BLOCK, CHUNK, RECORD_HEADER, RECORDS_AT = 4096, 65536, 24, 512
FILE_MAGIC, CHUNK_MAGIC, RECORD_MAGIC = b"ElfFile\0", b"ElfChnk\0", b"**\0\0"
DIRTY, FULL, NO_CRC = 1, 2, 4


@dataclass(frozen=True)
class Settings:
    separate_attributes: bool = True
    indent: bool = True
    ansi_codec: str = "windows-1252"
    validate_checksums: bool = False
    #: GUID (lower-case, no braces) to the body of a provider's template.
    offline: Callable[[str], bytes | None] | None = None


def file_header(block: bytes) -> dict:
    """The header's fields; DecodeError if it's short or has another magic. Unknown flags are ignored."""
    if len(block) < 128:
        raise DecodeError("Input", f"a file of {len(block)} bytes has no header")
    if block[:8] != FILE_MAGIC:
        raise DecodeError("InvalidFileMagic", f"file magic is {block[:8]!r}")
    first, last, following = struct.unpack_from("<QQQ", block, 8)
    size, minor, major, block_size, chunks = struct.unpack_from("<IHHHH", block, 32)
    flags, checksum = struct.unpack_from("<II", block, 120)
    return {"first_chunk": first, "last_chunk": last, "next_record_id": following, "header_size": size, "minor": minor, "major": major, "header_block_size": block_size, "chunk_count": chunks, "flags": flags, "checksum": checksum, "is_dirty": bool(flags & DIRTY), "is_full": bool(flags & FULL)}


def chunk_places(size: int, block_size: int = HEADER_BLOCK) -> int:
    """Chunks that a file of this size can hold, whatever its header says."""
    return max(0, (size - block_size) // CHUNK)


@dataclass
class Chunk:
    """One chunk: parsed header, names, and a decoder of its records."""

    data: bytes
    settings: Settings = Settings()
    header: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        d = self.data
        if len(d) < RECORDS_AT:
            raise DecodeError("Truncated", f"a chunk of {len(d)} bytes")
        if d[:8] != CHUNK_MAGIC:
            raise DecodeError("InvalidChunkMagic", f"chunk magic is {d[:8]!r}")
        numbers = struct.unpack_from("<QQQQ", d, 8)
        size, last, free, events_crc = struct.unpack_from("<IIII", d, 40)
        flags, crc = struct.unpack_from("<II", d, 120)
        self.header = {"first_record_number": numbers[0], "last_record_number": numbers[1], "first_record_id": numbers[2], "last_record_id": numbers[3], "header_size": size, "last_record_offset": last, "free_space_offset": free, "events_crc": events_crc, "flags": flags, "header_crc": crc, "record_count": max(0, numbers[3] - numbers[2] + 1)}
        self.known: dict[int, tuple[str, int]] = {}
        self.programs: dict[tuple, Program | None] = {}
        self.decoder = Decoder(d, self.name, self.settings.ansi_codec, self.settings.offline)

    def checksums(self) -> tuple[bool, bool]:
        """Whether the header's and the records' CRC32 fit; both do if the chunk says it has none."""
        h, d = self.header, self.data
        if h["flags"] & NO_CRC:
            return True, True
        return zlib.crc32(d[128:512], zlib.crc32(d[:120])) == h["header_crc"], zlib.crc32(d[RECORDS_AT : min(h["free_space_offset"], len(d))]) == h["events_crc"]

    def name(self, data: bytes, at: int) -> tuple[str, int]:
        """A name reference; a definition that stands right behind it is skipped. Names are
        decoded where they are, so one that the string table misses is found too."""
        if at + 4 > len(data):
            raise DecodeError("Truncated", "name reference", at)
        offset = struct.unpack_from("<I", data, at)[0]
        at += 4
        found = self.known.get(offset)
        if found is None:
            text, _, after = name_entry(data, offset)
            found = self.known[offset] = text, after
        return found[0], found[1] if offset == at else at

    def records(self) -> Iterator[tuple[int, int, int, int] | DecodeError]:
        """(offset, size, id, FILETIME) of each record. A zero or cut record header ends the
        chunk; a damaged one gives one error and ends it."""
        d, at = self.data, RECORDS_AT
        end, last = min(self.header["free_space_offset"], len(d)), self.header["last_record_id"]
        while at + RECORD_HEADER <= end:
            if d[at : at + 4] != RECORD_MAGIC:
                if d[at : at + 4] != b"\0\0\0\0":
                    yield DecodeError("InvalidRecordMagic", f"record magic is {bytes(d[at : at + 4])!r}", at)
                return
            size, record_id, time = struct.unpack_from("<IQQ", d, at + 4)
            if size < RECORD_HEADER + 4:
                yield DecodeError("InvalidRecordSize", f"a record's size should be at least 28, it is {size}", at)
                return
            if at + size > len(d):
                yield DecodeError("Truncated", f"a record of {size} bytes leaves the chunk", at)
                return
            yield at, size, record_id, time
            if record_id == last:
                return
            at += size

    def single_instance(self, at: int, size: int) -> Instance | None:
        """The record's template instance, if the record is a fragment header and one instance."""
        d, start, end = self.data, at + RECORD_HEADER, at + size - 4
        if end - start < 14 or d[start] != 0x0F or d[start + 4] != 0x0C:
            return None
        made, after = self.decoder.instance(start + 5)
        return made if after >= end or d[after] == 0 else None

    def rendered(self, made: Instance, *, xml: bool) -> tuple[str, bool] | None:
        """(text, whether JSON keys can't repeat) of an instance by its shape's program; None if the plain way is needed."""
        shape = shape_of(made.values)
        if shape is None:
            return None
        key = made.offset, xml, shape
        if key not in self.programs:
            self.programs[key] = compiled(self.decoder.template(made.offset), made.values, xml=xml, separate=self.settings.separate_attributes, indent=self.settings.indent)
        program = self.programs[key]
        return None if program is None else (program.fill(xml_texts(made.values) if xml else json_texts(made.values)), program.unique)

    def quick(self, at: int, size: int, *, json: bool, xml: bool) -> dict | None:
        """Raw, the viewer's columns and xml of a record whose shape's programs are known; None if not."""
        d, start, end = self.data, at + RECORD_HEADER, at + size - 4
        if end - start < 14 or d[start] != 0x0F or d[start + 4] != 0x0C:
            return None
        try:
            found = slots(d, start + 5, end, start)
        except DecodeError:
            return None  # the plain way tells the error
        if found is None:
            return None
        offset, texts, shape, plain = found
        out: dict = {}
        if json:
            program = self.programs.get((offset, False, shape))
            if program is None or not program.unique:
                return None
            if program.marked is not None:
                program.columns, program.marked = column_slots(program.marked, shape), None
            if program.columns is None:
                return None
            out = {"Raw": json_of(program, texts, plain), **columns_of(program.columns, plain)}
        if xml:
            program = self.programs.get((offset, True, shape))
            if program is None:
                return None
            out["xml"] = xml_of(program, texts, plain)
        return out

    def tree(self, at: int, size: int) -> Element:
        return self.decoder.parse(at + RECORD_HEADER, size - RECORD_HEADER - 4, template=False, depth=0)

    def instances(self, at: int, size: int) -> list[dict]:
        out = []
        for made in self.decoder.instances(at + RECORD_HEADER, size - RECORD_HEADER - 4):
            guid = made.guid
            if guid is None and made.offset + 24 <= len(self.data):
                guid = guid_text(bytes(self.data[made.offset + 4 : made.offset + 20]))
            out.append({"template_id": made.template_id, "def_offset": made.offset, "guid": guid, "substitutions": [{"type": type_of(v), "text": v if isinstance(v, str) else "" if v.kind == 0x21 else v.text()} for _, v in made.values]})
        return out


def error(e: DecodeError) -> dict:
    return {"code": e.code, "message": e.message, "offset": e.offset}


def signed(n: int) -> int | None:
    """An unsigned 64-bit id as a long; null beyond its range."""
    return n if n < 1 << 63 else None


def safe_time(n: int) -> datetime | None:
    try:
        return filetime(n)
    except DecodeError:
        return None


def decode_chunk(data: bytes, settings: Settings = Settings(), *, xml: bool = False, json: bool = True, programs: bool = True) -> Iterator[dict]:
    """A dict for each record, or for each error: record_id, ts, row_in_chunk, Raw, the
    viewer's columns, xml, error. Without ``programs`` all records take the plain way."""
    try:
        chunk = Chunk(data, settings)
        if settings.validate_checksums and not all(chunk.checksums()):
            raise DecodeError("ChecksumMismatch", "a chunk's checksum doesn't fit")
    except DecodeError as e:
        yield {"row_in_chunk": 0, "error": error(e)}
        return
    for i, r in enumerate(chunk.records()):
        yield {"row_in_chunk": i, "error": error(r)} if isinstance(r, DecodeError) else plain_row(chunk, i, r, json=json, xml=xml, programs=programs)


def plain_row(chunk: Chunk, i: int, r: tuple[int, int, int, int], *, json: bool, xml: bool, programs: bool = True) -> dict:
    """The row of one record of a chunk: (offset, size, id, FILETIME) as ``records`` gives them."""
    at, size, record_id, time = r
    settings = chunk.settings
    row = {"row_in_chunk": i, "record_id": signed(record_id), "ts": safe_time(time)}
    try:
        known = chunk.quick(at, size, json=json, xml=xml) if programs and (json or xml) else None
        if known is not None and row["record_id"] is not None:
            return row | known
        made = chunk.single_instance(at, size) if programs else None
        fast_json = chunk.rendered(made, xml=False) if made and json else None
        fast_xml = chunk.rendered(made, xml=True) if made and xml else None
        tree = None if (not json or fast_json) and (not xml or fast_xml) else chunk.tree(at, size)
        if json:
            if fast_json and fast_json[1]:
                raw, document = fast_json[0], codec.loads(fast_json[0])
            else:
                raw, document = parsed(fast_json[0] if fast_json else to_json(tree, separate=settings.separate_attributes))
            row |= {"Raw": raw, **system_columns(document)}
        if xml:
            row["xml"] = fast_xml[0] if fast_xml else to_xml(tree, indent=settings.indent)
    except (DecodeError, struct.error, RecursionError) as e:
        row["error"] = error(e if isinstance(e, DecodeError) else DecodeError("Deserialization", str(e), at))
    if row["record_id"] is None:
        row["error"] = {"code": "RecordId", "message": f"record id {record_id} doesn't fit in a signed long", "offset": at}
    return row


def iterate_chunks(read: Callable[[int, int], bytes], size: int, first: int = 0, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of the chunks of a file that aren't all zero, read one at a time."""
    head = file_header(read(0, 128))
    block = head["header_block_size"] or HEADER_BLOCK
    for n in range(first, min(stop if stop is not None else 1 << 62, chunk_places(size, block))):
        data = read(block + n * CHUNK, CHUNK)
        if data.count(0) != len(data):
            yield n, data
