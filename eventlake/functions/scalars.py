"""Scalar functions of the event model, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1601-01-01 to 1970-01-01.
EPOCH_US = 11_644_473_600_000_000
LEVEL_NAMES = {0: "LogAlways", 1: "Critical", 2: "Error", 3: "Warning", 4: "Information", 5: "Verbose"}


def filetime_to_timestamp(ft: Column) -> Column:
    """100 ns since 1601 to a timestamp, cut to microseconds."""
    return F.timestamp_micros(F.floor(ft / F.lit(10).cast("decimal(20,0)")).cast("long") - F.lit(EPOCH_US))


def timestamp_to_filetime(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) + F.lit(EPOCH_US)) * 10


def timestamp_text(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def bucket_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def systemtime_to_timestamp(parts: Column) -> Column:
    """An array (year, month, weekday, day, hour, minute, second, ms); all zeros are 1601-01-01, invalid parts are null."""
    get = lambda i: F.element_at(parts, i + 1).cast("int")
    made = F.try_make_timestamp(get(0), get(1), get(3), get(4), get(5), get(6) + get(7) / F.lit(1000).cast("decimal(10,6)"))
    return F.when(F.forall(parts, lambda x: x == 0), F.lit("1601-01-01 00:00:00").cast("timestamp")).otherwise(made)


def guid_text(b: Column) -> Column:
    """16 bytes to upper-case text without braces; the first three groups are little-endian."""
    digits = F.hex(b)
    take = lambda *starts: [F.substring(digits, s, 2) for s in starts]
    return F.concat(*take(7, 5, 3, 1), F.lit("-"), *take(11, 9), F.lit("-"), *take(15, 13), F.lit("-"), F.substring(digits, 17, 4), F.lit("-"), F.substring(digits, 21, 12))


def normalised_guid(g: Column) -> Column:
    """Without space and braces, lower-case: the form that joins use."""
    return F.lower(F.btrim(F.btrim(g), F.lit("{}")))


def hex_text(n: Column) -> Column:
    """``0x`` and lower-case digits without padding."""
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))


def binary_text(b: Column) -> Column:
    return F.hex(b)


def bool_from_int(n: Column) -> Column:
    return n != 0


def utf16_text(b: Column) -> Column:
    """UTF-16LE up to the first NUL."""
    return F.substring_index(F.decode(b, "UTF-16LE"), "\0", 1)


def ansi_text(b: Column, charset: str = "windows-1252") -> Column:
    """Text of single bytes without NULs. Spark decodes ISO 8859-1 and the Unicode forms;
    another single-byte set is decoded as ISO 8859-1 and its letters are exchanged."""
    if charset.lower() in ("iso-8859-1", "us-ascii", "utf-8"):
        return F.replace(F.decode(b, charset), F.lit("\0"), F.lit(""))
    pairs = [(chr(i), bytes([i]).decode(charset, "ignore")) for i in range(0x80, 0x100)]
    pairs = [(x, y) for x, y in pairs if y and x != y]
    text = F.translate(F.decode(b, "iso-8859-1"), "".join(x for x, _ in pairs), "".join(y for _, y in pairs))
    return F.replace(text, F.lit("\0"), F.lit(""))


def json_escaped(c: Column) -> Column:
    """The inside of a JSON string literal."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(3), F.length(text) - 4)


def xml_escaped(c: Column, *, attribute: bool = True) -> Column:
    for plain, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&apos;")] if attribute else [])]:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def joined(array: Column) -> Column:
    return F.array_join(array, ",")


def name_hash(c: Column) -> Column:
    """h = h * 65599 + code unit, low 16 bits, for names in the basic plane."""
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: (h * 65599 + F.ascii(x)) % 65536)


def is_optional_empty(c: Column) -> Column:
    return c.isNull() | (F.length(c) == 0)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def file_id(name: Column, size: Column) -> Column:
    return F.concat_ws("_", name, size.cast("string"))


def without_sentinel(c: Column, sentinel: int) -> Column:
    """Message ids and offsets use a number for none."""
    return F.nullif(c, F.lit(sentinel))


def level_name(level: Column, default: int = 4) -> Column:
    names = F.create_map(*[x for k, v in LEVEL_NAMES.items() for x in (F.lit(k), F.lit(v))])
    shown = F.coalesce(level, F.lit(default))
    return F.coalesce(F.try_element_at(names, shown), shown.cast("string"))


def json_text(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, path)


def event_time(text: Column) -> Column:
    """A SystemTime text (6 to 9 digits, Z) to a timestamp; null if it's none."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^(.*\.\d{6})\d*Z?$", "$1Z"))
