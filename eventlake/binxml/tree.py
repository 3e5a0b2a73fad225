"""BinXML tokens to an element tree, with templates instantiated and arrays expanded."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from . import values as V
from .values import DecodeError, Value, need, read, utf16

#: Nesting that no sane record reaches.
MOST_FRAGMENTS, MOST_ELEMENTS = 64, 512


@dataclass(slots=True)
class Element:
    name: str
    attrs: list[tuple[str, list]] = field(default_factory=list)
    children: list = field(default_factory=list)


@dataclass(frozen=True, slots=True)
class Entity:
    name: str


@dataclass(frozen=True, slots=True)
class Instruction:
    """A processing instruction's target, or its data."""

    target: str | None
    data: str | None = None


@dataclass(frozen=True, slots=True)
class Placeholder:
    index: int
    kind: int
    optional: bool


@dataclass(slots=True)
class Instance:
    """A template instance: where its definition is, and its substitution values."""

    template_id: int
    offset: int
    guid: str | None
    values: list[tuple[int, object]]


Names = Callable[[bytes, int], tuple[str, int]]


def inline_name(data: bytes, at: int) -> tuple[str, int]:
    """A name in place, as provider templates have it: hash, count, UTF-16, NUL; the hash must fit."""
    need(data, at, 4, "name")
    stored, n = struct.unpack_from("<HH", data, at)
    need(data, at + 4, 2 * n + 2, "name")
    raw = bytes(data[at + 4 : at + 4 + 2 * n])
    h = 0
    for unit in struct.unpack(f"<{n}H", raw):
        h = (h * 65599 + unit) & 0xFFFFFFFF
    if h & 0xFFFF != stored:
        raise DecodeError("NameHash", f"name hash {h & 0xFFFF:#06x}, stored {stored:#06x}", at)
    if data[at + 4 + 2 * n : at + 6 + 2 * n] != b"\0\0":
        raise DecodeError("InvalidData", "a name has no NUL", at)
    try:
        return raw.decode("utf-16-le"), at + 6 + 2 * n
    except UnicodeDecodeError as e:
        raise DecodeError("InvalidData", f"name: {e}", at) from e


def name_entry(data: bytes, at: int) -> tuple[str, int, int]:
    """(name, next entry's offset, place after) of a string table entry."""
    need(data, at, 8, "string table entry")
    following, _, n = struct.unpack_from("<IHH", data, at)
    need(data, at + 8, 2 * n + 2, "string table entry")
    try:
        return bytes(data[at + 8 : at + 8 + 2 * n]).decode("utf-16-le"), following, at + 10 + 2 * n
    except UnicodeDecodeError as e:
        raise DecodeError("InvalidData", f"name: {e}", at) from e


class Decoder:
    """Trees from the bytes of one chunk (or of one provider template)."""

    def __init__(self, data: bytes, names: Names, codec: str = "windows-1252", offline: Callable[[str], bytes | None] | None = None):
        self.data, self.names, self.codec, self.offline = data, names, codec, offline
        self.templates: dict[int, tuple[str, Element]] = {}

    # Token streams

    def instance(self, at: int) -> tuple[Instance, int]:
        """The template instance after its token; values keep fragments as (place, size)."""
        data = self.data
        need(data, at, 9, "template instance")
        template_id, offset = struct.unpack_from("<II", data, at + 1)
        at += 9
        guid = None
        if at == offset:  # the definition is here
            guid, size = self.definition_header(at)
            at += 24 + size
        need(data, at, 4, "template values")
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        need(data, at, 4 * n, "value descriptors")
        described = [struct.unpack_from("<HB", data, at + 4 * i) for i in range(n)]
        at += 4 * n
        made = []
        for size, kind in described:
            if kind not in V.VALID:
                V.type_name(kind)
            value, after = read(kind, data, at, size, self.codec)
            made.append((kind, value))
            # The declared size counts, whatever the value took; it never goes back.
            at = max(after, at + size)
        need(data, at, 0, "template values")
        return Instance(template_id, offset, guid, made), at

    def definition_header(self, at: int) -> tuple[str, int]:
        need(self.data, at, 24, "template definition")
        return V.guid_text(bytes(self.data[at + 4 : at + 20])), struct.unpack_from("<I", self.data, at + 20)[0]

    def template(self, offset: int) -> Element:
        """The definition at a place, parsed once; a provider's template where it's damaged."""
        found = self.templates.get(offset)
        if found is None:
            guid, size = self.definition_header(offset)
            try:
                need(self.data, offset + 24, size, "template body")
                tree = self.parse(offset + 24, size, template=True, depth=0)
            except DecodeError as e:
                body = self.offline(guid) if self.offline else None
                if body is None:
                    raise
                try:
                    tree = Decoder(body, inline_name, self.codec).parse(0, len(body), template=True, depth=0)
                except DecodeError:
                    raise e from None
            found = self.templates[offset] = (guid, tree)
        return found[1]

    def parse(self, at: int, size: int, *, template: bool, depth: int) -> Element:
        """The tree of a fragment. Of a record's several roots the first counts; one without
        any is an empty Event. A template has exactly one root, and keeps its placeholders."""
        if depth > MOST_FRAGMENTS:
            raise DecodeError("TooDeep", "BinXML fragments nested too deeply", at)
        data, end = self.data, at + size
        need(data, at, size, "fragment")
        stack: list[Element] = []
        opened: Element | None = None
        root: Element | None = None

        def attach(e: Element) -> None:
            nonlocal root
            if stack:
                stack[-1].children.append(e)
            elif root is None:
                root = e
            elif template:
                raise DecodeError("Tree", "multiple root elements", at)

        def push(node: object) -> None:
            if opened is not None:
                if not opened.attrs:
                    raise DecodeError("Tree", "value before an attribute's name", at)
                opened.attrs[-1][1].append(node)
            elif stack:
                stack[-1].children.append(node)
            else:
                raise DecodeError("Tree", "value outside of element", at)

        while at < end:
            token = data[at]
            at += 1
            if token == 0x00:
                break
            if token == 0x0F:
                need(data, at, 3, "fragment header")
                at += 3
            elif token in (0x01, 0x41):
                if opened is not None:
                    raise DecodeError("Tree", "element inside a start tag", at)
                at += 2 if template else 0  # dependency id
                need(data, at, 4, "element")
                name, at = self.names(data, at + 4)
                if token == 0x41:
                    need(data, at, 4, "attribute list")
                    at += 4
                opened = Element(name)
            elif token in (0x06, 0x46):
                if opened is None:
                    raise DecodeError("Tree", "attribute outside a start tag", at)
                name, at = self.names(data, at)
                opened.attrs.append((name, []))
            elif token in (0x02, 0x03):
                if opened is None:
                    raise DecodeError("Tree", "end of a start tag that isn't open", at)
                if token == 0x03:
                    attach(opened)
                elif len(stack) >= MOST_ELEMENTS:
                    raise DecodeError("TooDeep", "BinXML elements nested too deeply", at)
                else:
                    stack.append(opened)
                opened = None
            elif token == 0x04:
                if not stack:
                    raise DecodeError("Tree", "end tag without a start tag", at)
                attach(stack.pop())
            elif token in (0x05, 0x45):
                need(data, at, 1, "value type")
                kind = data[at]
                V.type_name(kind)
                value, at = read(kind, data, at + 1, None, self.codec)
                if kind == V.BINXML:
                    if opened is not None:
                        raise DecodeError("Tree", "nested BinXML inside attribute value", at)
                    if value.data:
                        attach(self.parse(*value.data, template=False, depth=depth + 1))
                else:
                    push(value)
            elif token in (0x0D, 0x0E):
                if not template:
                    raise DecodeError("Tree", "substitution outside template definition", at)
                need(data, at, 3, "substitution")
                index, kind = struct.unpack_from("<HB", data, at)
                V.type_name(kind)
                at += 3
                push(Placeholder(index, kind, token == 0x0E))
            elif token == 0x0C:
                if template or opened is not None:
                    raise DecodeError("Tree", "template instance out of place", at)
                made, at = self.instance(at)
                attach(self.instantiate(made, depth))
            elif token in (0x09, 0x49):
                name, at = self.names(data, at)
                push(Entity(name))
            elif token == 0x0A:
                name, at = self.names(data, at)
                push(Instruction(name))
            elif token == 0x0B:
                text, at = read(V.STRING, data, at, None, self.codec)
                push(Instruction(None, text))
            elif token in (0x07, 0x47, 0x08, 0x48):
                raise DecodeError("UnimplementedToken", "CDataSection" if token & 0x0F == 7 else "CharReference", at)
            else:
                raise DecodeError("InvalidToken", f"invalid token 0x{token:02x}", at - 1)
        if opened is not None or stack:
            raise DecodeError("Tree", "unfinished element", at)
        if root is None:
            if template:
                raise DecodeError("Tree", "missing root element", at)
            return Element("Event")
        return root

    # Templates

    def instantiate(self, made: Instance, depth: int) -> Element:
        if depth > MOST_FRAGMENTS:
            raise DecodeError("TooDeep", "BinXML fragments nested too deeply", made.offset)
        values: list[object] = []
        for kind, v in made.values:
            if kind == V.BINXML:
                values.append(self.parse(*v.data, template=False, depth=depth + 1) if v.data else Value(V.NULL, None))
            else:
                values.append(v)
        return resolved(self.template(made.offset), values)

    def instances(self, at: int, size: int) -> list[Instance]:
        """All template instances of a record's top level, with those of nested fragments."""
        out: list[Instance] = []
        todo = [(at, size)]
        while todo:
            at, size = todo.pop(0)
            end = at + size
            while at < end:
                token = self.data[at]
                at += 1
                if token == 0x0F:
                    at += 3
                elif token == 0x0C:
                    made, at = self.instance(at)
                    out.append(made)
                    todo += [v.data for k, v in made.values if k == V.BINXML and v.data]
                else:
                    break
        return out


def is_empty(value: object) -> bool:
    """Whether an optional substitution leaves nothing."""
    return value == "" if isinstance(value, str) else value.empty if isinstance(value, Value) else False


def resolved(e: Element, values: list[object]) -> Element:
    """The template's tree with its placeholders replaced. The root isn't repeated."""
    out = Element(e.name)
    for name, nodes in e.attrs:
        new = [n for node in nodes for n in _resolve(node, values)]
        if new:
            out.attrs.append((name, new))
    for node in e.children:
        if isinstance(node, Element):
            out.children += expanded(resolved(node, values))
        else:
            out.children += _resolve(node, values)
    return out


def _resolve(node: object, values: list[object]) -> list[object]:
    if not isinstance(node, Placeholder):
        return [node]
    if node.index >= len(values):
        return []
    value = values[node.index]
    if node.optional and is_empty(value):
        return []
    if isinstance(value, Value) and value.kind in (V.EVTXML, V.HANDLE, V.BINXML):
        raise DecodeError("Unimplemented", f"{V.NAMES[value.kind]} in a substitution")
    return [value]


def _array_at(e: Element) -> tuple[int | None, int, Value] | None:
    """(attribute or None, place, array) of the first array of two or more: children before attributes."""
    for i, n in enumerate(e.children):
        if isinstance(n, Value) and n.expandable > 1:
            return None, i, n
    for a, (_, nodes) in enumerate(e.attrs):
        for i, n in enumerate(nodes):
            if isinstance(n, Value) and n.expandable > 1:
                return a, i, n
    return None


def expanded(e: Element) -> list[Element]:
    """The element once for each item of its arrays: the first array varies slowest. An empty
    string leaves nothing in its place."""
    found = _array_at(e)
    if found is None:
        return [e]
    a, i, array = found
    out: list[Element] = []
    for k in range(len(array.data)):
        item = array.item(k)
        new = [] if item == "" else [item]
        attrs = [(n, nodes[:i] + new + nodes[i + 1 :] if j == a else nodes) for j, (n, nodes) in enumerate(e.attrs)]
        children = e.children[:i] + new + e.children[i + 1 :] if a is None else e.children
        out += expanded(Element(e.name, attrs, children))
    return out
