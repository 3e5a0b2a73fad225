"""Records of a known shape in one pass: value bytes to output text, without value objects.

A record that is one template instance whose definition was met before is read by its
value descriptors. Each slot gives its text, a code for its kind and emptiness, and the
plain value; the codes find the shape's program, whose literals and texts are joined.
The viewer's columns come from the slots that the program found for them. Anything
unusual (other kinds, odd sizes, a definition in place) gives None: the plain way.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

from . import values as V
from .program import Program
from .render import ATTRIBUTE_ESCAPES, TEXT_ESCAPES, escape_json

_JSON_ODD = re.compile('[\x00-\x1f"\\\\\ud800-\udfff]')
_XML_ODD = re.compile("[&<>\"']")
_ONE_MARK = re.compile("\ue000([0-9]+)([atb])\ue001")
_INTEGERS = {V.INT8: (1, True), V.UINT8: (1, False), V.INT16: (2, True), V.UINT16: (2, False), V.INT32: (4, True), V.UINT32: (4, False), V.INT64: (8, True), V.UINT64: (8, False)}
_HEX = {V.HEX32: 4, V.HEX64: 8}


@lru_cache(maxsize=4096)
def _sid(raw: bytes) -> str:
    return V.sid_text(raw)


@lru_cache(maxsize=4096)
def _guid(raw: bytes) -> str:
    return V.guid_text(raw)


@lru_cache(maxsize=64)
def _pairs(n: int) -> struct.Struct:
    return struct.Struct(f"<{2 * n}H")


def slots(data: bytes, at: int, end: int, template_at: int) -> tuple[int, list[str], tuple, list] | None:
    """(definition's place, texts, shape, plain values) of the instance behind ``at`` (its token's
    byte before), or None."""
    offset = int.from_bytes(data[at + 5 : at + 9], "little")
    p = at + 9
    if p == offset or p + 4 > end:
        return None
    n = int.from_bytes(data[p : p + 4], "little")
    p += 4
    if n > 1024 or p + 4 * n > end:
        return None
    described = _pairs(n).unpack_from(data, p)
    p += 4 * n
    texts, shape, plain = [], [], []
    for k in range(n):
        size, kind = described[2 * k], described[2 * k + 1] & 0xFF
        stop = p + size
        if kind == V.STRING:
            if size & 1 or stop > end:
                return None
            text = data[p:stop].decode("utf-16-le", "ignore")
            if "\0" in text:
                text = text[: text.index("\0")]
            texts.append(text)
            plain.append(text)
            shape.append(V.STRING if text else -1)
        elif kind in _INTEGERS:
            wide, sign = _INTEGERS[kind]
            if size != wide or stop > end:
                return None
            x = int.from_bytes(data[p:stop], "little", signed=sign)
            texts.append(str(x))
            plain.append(x)
            shape.append(kind)
        elif kind == V.NULL:
            texts.append("")
            plain.append(None)
            shape.append(-2)
            stop = p + size
        elif kind == V.FILETIME:
            if size != 8 or stop > end:
                return None
            t = V.filetime(int.from_bytes(data[p:stop], "little"), p)
            texts.append(V.time_text(t))
            plain.append(None)
            shape.append(kind)
        elif kind in _HEX:
            if size != _HEX[kind] or stop > end:
                return None
            texts.append(hex(int.from_bytes(data[p:stop], "little")))
            plain.append(None)
            shape.append(kind)
        elif kind == V.SID:
            if size < 8 or stop > end or size != 8 + 4 * data[p + 1]:
                return None
            texts.append(_sid(bytes(data[p:stop])))
            plain.append(None)
            shape.append(kind)
        elif kind == V.GUID:
            if size != 16 or stop > end:
                return None
            texts.append(_guid(bytes(data[p:stop])))
            plain.append(None)
            shape.append(kind)
        elif kind == V.BOOL:
            if size != 4 or stop > end:
                return None
            texts.append("true" if data[p:stop] != b"\0\0\0\0" else "false")
            plain.append(None)
            shape.append(kind)
        else:
            return None
        p = stop
    if p > end or p < end and data[p] != 0:
        return None
    return offset, texts, tuple(shape), plain


def json_of(program: Program, texts: list[str], plain: list) -> str:
    """The program's JSON with these texts; only strings can need escapes."""
    shown = [escape_json(t) if isinstance(x, str) and _JSON_ODD.search(t) else t for t, x in zip(texts, plain, strict=True)]
    return program.joined([shown[s] for s, _ in program.holes])


def xml_of(program: Program, texts: list[str], plain: list) -> str:
    def text(s: int, attribute: bool) -> str:
        t = texts[s]
        if isinstance(plain[s], str) and _XML_ODD.search(t):
            return t.translate(ATTRIBUTE_ESCAPES if attribute else TEXT_ESCAPES)
        return t

    return program.joined([text(s, a) for s, a in program.holes])


def integer(x: object) -> int | None:
    """A 32-bit number from a JSON number (wrapped as a cast would) or from a text of digits."""
    if isinstance(x, bool):
        return None
    if isinstance(x, int):
        return (x + (1 << 31)) % (1 << 32) - (1 << 31)
    if isinstance(x, str):
        try:
            n = int(x)
        except ValueError:
            return None
        return n if -(1 << 31) <= n < 1 << 31 and x.lstrip("+-").isdigit() else None
    return None


def system_nodes(document: dict) -> tuple[object, object, list, object]:
    """What the viewer's columns are read from: EventID, Level, the names that may be the
    provider's (the first text counts), and Channel."""
    event = document.get("Event")
    system = event.get("System") if isinstance(event, dict) else None
    system = system if isinstance(system, dict) else {}
    event_id = system.get("EventID")
    if isinstance(event_id, dict):
        event_id = event_id.get("#text") if isinstance(event_id.get("#text"), str) else None
    provider = system.get("Provider")
    holders = [provider, system.get("Provider_attributes"), provider.get("#attributes") if isinstance(provider, dict) else None]
    return event_id, system.get("Level"), [h["Name"] for h in holders if isinstance(h, dict) and "Name" in h], system.get("Channel")


def system_columns(document: dict) -> dict:
    """EventID, Level, Provider and Channel by the viewer's rules."""
    event_id, level, names, channel = system_nodes(document)
    shown = next((n for n in names if isinstance(n, str)), "")
    return {"EventID": integer(event_id), "Level": integer(level) if isinstance(level, int) and not isinstance(level, bool) else 4, "Provider": shown, "Channel": channel if isinstance(channel, str) else ""}


def _bare_text(marked: dict) -> bool:
    """Whether the marked document's EventID is an object whose text is a bare number."""
    node = marked
    for key in ("Event", "System", "EventID"):
        node = node.get(key) if isinstance(node, dict) else None
    m = _ONE_MARK.fullmatch(node["#text"]) if isinstance(node, dict) and isinstance(node.get("#text"), str) else None
    return bool(m) and m[2] == "b"


def column_slots(marked: dict, shape: tuple) -> tuple | None:
    """How a shape's columns are found: for each of EventID, Level, Provider and Channel (a
    constant, None) or (None, slot); None if the document has to be read."""

    def found(node: object) -> tuple[int, bool] | None | bool:
        """(slot, bare), None without a mark, False if the mark isn't the whole text."""
        if not isinstance(node, str) or "\ue000" not in node:
            return None
        m = _ONE_MARK.fullmatch(node)
        return (int(m[1]), m[2] == "b") if m else False

    event_id, level, names, channel = system_nodes(marked)
    if _bare_text(marked):
        event_id = None  # a number beside attributes isn't a text
    number = range(V.INT8, V.UINT64 + 1)
    out: list[tuple] = []
    at = found(event_id)
    if at is None:
        out.append((integer(event_id), None))
    elif at and (at[1] and shape[at[0]] in number or not at[1] and shape[at[0]] == V.STRING):
        out.append((None, at[0]))
    else:
        return None
    at = found(level)
    if at is None:
        out.append((integer(level) if isinstance(level, int) and not isinstance(level, bool) else 4, None))
    elif at and at[1] and shape[at[0]] in number:
        out.append((None, at[0]))
    elif at and not at[1]:
        out.append((4, None))
    else:
        return None
    for node in (names[0] if names else "", channel):
        at = found(node)
        if at is None and isinstance(node, str):
            out.append((node, None))
        elif at is None and node is channel:
            out.append(("", None))
        elif at and not at[1] and shape[at[0]] == V.STRING:
            out.append((None, at[0]))
        else:
            return None
    return tuple(out)


def columns_of(where: tuple, plain: list) -> dict:
    (e, es), (lv, ls), (p, ps), (c, cs) = where
    return {
        "EventID": e if es is None else integer(plain[es]),
        "Level": lv if ls is None else integer(plain[ls]),
        "Provider": p if ps is None else plain[ps],
        "Channel": c if cs is None else plain[cs],
    }
