"""Typed values: decoding from bytes, text, and JSON forms."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal

#: Type bytes. An array has bit 0x80 set.
NULL, STRING, ANSI, INT8, UINT8, INT16, UINT16, INT32, UINT32, INT64, UINT64 = range(0x00, 0x0B)
REAL32, REAL64, BOOL, BINARY, GUID, SIZET, FILETIME, SYSTIME, SID, HEX32, HEX64 = range(0x0B, 0x16)
HANDLE, BINXML, EVTXML, ARRAY = 0x20, 0x21, 0x23, 0x80
NAMES = {
    NULL: "Null", STRING: "String", ANSI: "AnsiString", INT8: "Int8", UINT8: "UInt8", INT16: "Int16", UINT16: "UInt16", INT32: "Int32", UINT32: "UInt32", INT64: "Int64", UINT64: "UInt64",
    REAL32: "Real32", REAL64: "Real64", BOOL: "Bool", BINARY: "Binary", GUID: "Guid", SIZET: "SizeT", FILETIME: "FileTime", SYSTIME: "SysTime", SID: "Sid", HEX32: "HexInt32", HEX64: "HexInt64",
    HANDLE: "EvtHandle", BINXML: "BinXml", EVTXML: "EvtXml",
}
_FIXED = {INT8: "<b", UINT8: "<B", INT16: "<h", UINT16: "<H", INT32: "<i", UINT32: "<I", INT64: "<q", UINT64: "<Q", REAL32: "<f", REAL64: "<d", BOOL: "<i", GUID: "16s", FILETIME: "<Q", SYSTIME: "<8H", HEX32: "<I", HEX64: "<Q"}
_NUMBERS = frozenset(range(INT8, UINT64 + 1))
_NO_ARRAY = frozenset({ANSI, BINARY, SIZET, NULL})
EPOCH = datetime(1601, 1, 1)


class DecodeError(ValueError):
    """Damaged or unsupported data; ``code`` is a short name and ``offset`` the place in the chunk."""

    def __init__(self, code: str, message: str, offset: int = 0):
        super().__init__(message)
        self.code, self.message, self.offset = code, message, offset


def type_name(kind: int) -> str:
    base = NAMES.get(kind & 0x7F if kind & ARRAY else kind)
    if base is None or (kind & ARRAY and kind & 0x7F >= HANDLE):
        raise DecodeError("InvalidValueVariant", f"invalid value type 0x{kind:02x}")
    return base + ("Array" if kind & ARRAY else "")


#: Type bytes that there are, so that a valid one costs no look-up of its name.
VALID = frozenset(k for k in range(256) if (k & 0x7F if k & ARRAY else k) in NAMES and not (k & ARRAY and k & 0x7F >= HANDLE))


@dataclass(frozen=True, slots=True)
class Value:
    """A typed value that isn't text. An array's data is a list of items of its element type."""

    kind: int
    data: object

    @property
    def empty(self) -> bool:
        return self.kind == NULL or (self.kind in (STRING, ANSI, BINARY, BINXML) or bool(self.kind & ARRAY)) and not self.data

    def item(self, i: int) -> Value | str:
        kind = self.kind & 0x7F
        return self.data[i] if kind == STRING else Value(kind, self.data[i])

    @property
    def expandable(self) -> int:
        """Items of an array that repeats its element."""
        return len(self.data) if self.kind & ARRAY else 0

    def text(self) -> str:
        if self.kind & ARRAY:
            kind = self.kind & 0x7F
            return ",".join(scalar_text(kind, x) for x in self.data)
        return scalar_text(self.kind, self.data)

    def json(self) -> str | None:
        """A bare JSON number or boolean, or None if the value is written as a string."""
        if self.kind in _NUMBERS:
            return str(self.data)
        if self.kind == BOOL:
            return "true" if self.data else "false"
        return None


#: Powers of ten from and up to which a number is written without exponent, by its width.
_PLAIN = {True: (-6, 13), False: (-5, 16)}


def real_text(x: float, single: bool) -> str:
    """Shortest digits that read back as the same number, always with a point or an exponent."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "inf" if x > 0 else "-inf"
    text = repr(float(x))
    if single:
        for digits in range(1, 10):
            text = f"{x:.{digits}g}"
            if struct.pack("<f", float(text)) == struct.pack("<f", x):
                break
    negative, all_digits, exponent = Decimal(text).as_tuple()
    shown = "".join(map(str, all_digits)).strip("0") or "0"
    exponent += len(all_digits) - len("".join(map(str, all_digits)).rstrip("0") or "0") if any(all_digits) else 0
    sign = "-" if negative else ""
    if shown == "0":
        return f"{sign}0.0"
    low, high = _PLAIN[single]
    point = len(shown) + exponent
    if exponent >= 0 and point <= high:
        return f"{sign}{shown}{'0' * exponent}.0"
    if 0 < point <= high:
        return f"{sign}{shown[:point]}.{shown[point:]}"
    if low < point <= 0:
        return f"{sign}0.{'0' * -point}{shown}"
    return f"{sign}{shown[0]}{'.' if len(shown) > 1 else ''}{shown[1:]}e{point - 1}"


def time_text(t: datetime) -> str:
    return f"{t.isoformat(timespec='microseconds')}Z"


def guid_text(b: bytes) -> str:
    a, c, d = struct.unpack_from("<IHH", b)
    return f"{a:08X}-{c:04X}-{d:04X}-{b[8:10].hex().upper()}-{b[10:16].hex().upper()}"


def sid_text(b: bytes) -> str:
    if len(b) < 8:
        return "S-?"
    subs = [struct.unpack_from("<I", b, 8 + 4 * i)[0] for i in range(min(b[1], (len(b) - 8) // 4))]
    return "-".join(map(str, ("S", b[0], int.from_bytes(b[2:8], "big"), *subs)))


def scalar_text(kind: int, x: object) -> str:
    if kind == NULL:
        return ""
    if kind in (STRING, ANSI):
        return x
    if kind in _NUMBERS:
        return str(x)
    if kind == BOOL:
        return "true" if x else "false"
    if kind in (REAL32, REAL64):
        return real_text(x, kind == REAL32)
    if kind == BINARY:
        return x.hex().upper()
    if kind == GUID:
        return guid_text(x)
    if kind in (FILETIME, SYSTIME):
        return time_text(x)
    if kind == SID:
        return sid_text(x)
    if kind in (HEX32, HEX64):
        return f"0x{x:x}"
    raise DecodeError("Unimplemented", f"{NAMES.get(kind, kind)} has no text")


def filetime(n: int, offset: int = 0) -> datetime:
    try:
        return EPOCH + timedelta(microseconds=n // 10)
    except OverflowError as e:
        raise DecodeError("InvalidTime", f"FILETIME {n} is out of range", offset) from e


def systime(parts: tuple[int, ...], offset: int) -> datetime:
    year, month, _, day, hour, minute, second, ms = parts
    if not any(parts):
        return EPOCH
    try:
        return datetime(year, month, day, hour, minute, second, ms * 1000)
    except ValueError as e:
        raise DecodeError("InvalidTime", f"SYSTEMTIME {parts}: {e}", offset) from e


def need(data: bytes, at: int, n: int, what: str) -> None:
    if n < 0 or at < 0 or at + n > len(data):
        raise DecodeError("Truncated", f"{what}: {n} bytes at {at}, {len(data)} there", at)


def utf16(raw: bytes, *, cut: bool = True) -> str:
    """Text up to the first NUL; halves of broken pairs are dropped."""
    text = raw.decode("utf-16-le", "ignore")
    return text.split("\0", 1)[0] if cut else text


def _fixed(kind: int, data: bytes, at: int) -> object:
    form = _FIXED[kind]
    need(data, at, struct.calcsize(form), NAMES[kind])
    parts = struct.unpack_from(form, data, at)
    if kind == SYSTIME:
        return systime(parts, at)
    if kind == FILETIME:
        return filetime(parts[0], at)
    return parts[0] != 0 if kind == BOOL else parts[0]


def read(kind: int, data: bytes, at: int, size: int | None, codec: str) -> tuple[Value | str, int]:
    """The value at a place and the place after it. size: its declared bytes, None in a token stream."""
    if kind == NULL:
        return Value(NULL, None), at
    if kind == STRING:
        if size is None:
            need(data, at, 2, "string length")
            n = 2 * struct.unpack_from("<H", data, at)[0]
            at += 2
        elif size % 2:
            raise DecodeError("InvalidData", "a UTF-16 string has an odd size", at)
        else:
            n = size
        need(data, at, n, "string")
        return utf16(data[at : at + n]), at + n
    if kind == SIZET:
        if size not in (4, 8):
            raise DecodeError("Unimplemented", f"SizeT of {size} bytes", at)
        return Value(HEX32 if size == 4 else HEX64, _fixed(HEX32 if size == 4 else HEX64, data, at)), at + size
    if kind in _FIXED:
        return Value(kind, _fixed(kind, data, at)), at + struct.calcsize(_FIXED[kind])
    if kind == SID:
        need(data, at, 8, "SID")
        n = 8 + 4 * data[at + 1]
        need(data, at, n, "SID")
        return Value(SID, data[at : at + n]), at + n
    if kind == BINXML:
        if size is None:
            need(data, at, 2, "fragment length")
            size = struct.unpack_from("<H", data, at)[0]
            at += 2
        need(data, at, size, "fragment")
        return Value(BINXML, (at, size) if size else None), at + size
    if size is None or kind in (HANDLE, EVTXML):
        raise DecodeError("Unimplemented", f"{type_name(kind)} of {size} bytes", at)
    need(data, at, size, type_name(kind))
    raw = bytes(data[at : at + size])
    if kind == ANSI:
        try:
            return raw.replace(b"\0", b"").decode(codec), at + size
        except UnicodeDecodeError as e:
            raise DecodeError("AnsiDecodeError", str(e), at) from e
    if kind == BINARY:
        return Value(BINARY, raw), at + size
    inner = kind & 0x7F
    if not kind & ARRAY or inner in _NO_ARRAY:
        raise DecodeError("Unimplemented", f"{type_name(kind)} isn't supported", at)
    if inner == STRING:
        items = []
        end = at + size
        while at < end:
            stop = at
            while True:
                need(data, stop, 2, "string array")
                if data[stop : stop + 2] == b"\0\0":
                    break
                stop += 2
            items.append(utf16(bytes(data[at:stop])))
            at = stop + 2
        return Value(kind, items), at
    if inner == SID:
        items, end = [], at + size
        while at < end:
            v, at = read(SID, data, at, None, codec)
            items.append(v.data)
        return Value(kind, items), at
    if inner not in _FIXED:
        raise DecodeError("Unimplemented", f"{type_name(kind)} isn't supported", at)
    wide = struct.calcsize(_FIXED[inner])
    if size % wide:
        raise DecodeError("InvalidData", f"{size} bytes are no array of {wide}-byte items", at)
    return Value(kind, [_fixed(inner, data, i) for i in range(at, at + size, wide)]), at + size
