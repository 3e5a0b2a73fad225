"""Element trees as XML and as JSON text."""

from __future__ import annotations

import json
import re
import sys

from . import values as V
from .tree import Element, Entity, Instruction, Placeholder
from .values import DecodeError, Value

# Elements nest up to 512 deep, and a level takes a few frames.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))

DECLARATION = '<?xml version="1.0" encoding="utf-8"?>\n'
ENTITIES = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">"}
TEXT_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
ATTRIBUTE_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})
_JSON = str.maketrans({**{chr(i): f"\\u{i:04X}" for i in range(0x20)}, '"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"})
_LONE = re.compile("[\ud800-\udfff]")


class Hole(Value):
    """A value that isn't there yet: it renders as a mark with its slot."""

    __slots__ = ()

    @property
    def empty(self) -> bool:
        return False

    @property
    def expandable(self) -> int:
        return 0

    def text(self) -> str:
        return f"\ue000{self.data}t\ue001"

    def json(self) -> str | None:
        return self.text() if V.INT8 <= self.kind <= V.UINT64 or self.kind == V.BOOL else None


def drop_lone(text: str) -> str:
    return text if text.isascii() else _LONE.sub("", text)


def escape_json(text: str) -> str:
    """The inside of a JSON string; lone surrogates are dropped."""
    return (_LONE.sub("", text) if not text.isascii() else text).translate(_JSON)


def _content(nodes: list) -> bool:
    """Whether there's anything that isn't an empty text or value."""
    return any(n != "" if isinstance(n, str) else not n.empty if isinstance(n, Value) else isinstance(n, (Entity, Placeholder)) for n in nodes)


# XML


def _xml_node(n: object, table: dict) -> str:
    if isinstance(n, str):
        return n.translate(table)
    if isinstance(n, Hole):
        return f"\ue000{n.data}{'a' if table is ATTRIBUTE_ESCAPES else 't'}\ue001"
    if isinstance(n, Value):
        return n.text().translate(table)
    if isinstance(n, Entity):
        return f"&{n.name};"
    raise DecodeError("Render", f"{type(n).__name__} out of place")


def _xml_inline(nodes: list) -> str:
    out, i = [], 0
    while i < len(nodes):
        n = nodes[i]
        if isinstance(n, Instruction):
            if n.target is None:
                raise DecodeError("Render", "PIData without PITarget")
            after = nodes[i + 1] if i + 1 < len(nodes) else None
            if isinstance(after, Instruction) and after.target is None:
                out.append(f"<?{n.target} {after.data}?>")
                i += 1
            else:
                out.append(f"<?{n.target}?>")
        else:
            out.append(_xml_node(n, TEXT_ESCAPES))
        i += 1
    return "".join(out)


def _xml(e: Element, level: int, indent: bool, out: list[str]) -> None:
    pad, line = ("  " * level, "\n") if indent else ("", "")
    attrs = "".join(f' {name}="{"".join(_xml_node(n, ATTRIBUTE_ESCAPES) for n in nodes)}"' for name, nodes in e.attrs if _content(nodes))
    out.append(f"{pad}<{e.name}{attrs}>")
    if not e.children:
        # An empty element closes on a line of its own, except Binary.
        out.append("" if e.name == "Binary" else line + pad)
    elif any(isinstance(n, Element) for n in e.children):
        out.append(line)
        for n in e.children:
            if isinstance(n, Element):
                _xml(n, level + 1, indent, out)
            else:
                out.append(f"{pad}{'  ' if indent else ''}{_xml_inline([n])}{line}")
        out.append(pad)
    else:
        out.append(_xml_inline(e.children))
    out.append(f"</{e.name}>{line}")


def to_xml(root: Element, *, indent: bool = True, declaration: bool = True) -> str:
    out = [DECLARATION] if declaration else []
    _xml(root, 0, indent, out)
    return _LONE.sub("", "".join(out))


# JSON


def _text(nodes: list) -> str:
    """The nodes' text, escaped; instructions and elements leave nothing."""
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(escape_json(n))
        elif isinstance(n, Value):
            out.append(escape_json(n.text()))
        elif isinstance(n, Entity):
            out.append(escape_json(ENTITIES[n.name]) if n.name in ENTITIES else f"&{n.name};")
        elif isinstance(n, Placeholder):
            raise DecodeError("Render", "unresolved placeholder")
    return "".join(out)


def _scalar(nodes: list) -> str:
    """One number or boolean bare, anything else as a string."""
    solid = [n for n in nodes if not isinstance(n, Element) and not (isinstance(n, Value) and n.empty) and n != ""]
    if len(solid) == 1 and isinstance(solid[0], Value):
        bare = solid[0].json()
        if bare is not None and len(nodes) == len(solid) + sum(isinstance(n, Element) for n in nodes):
            return bare
    return f'"{_text(nodes)}"'


def _attributes(e: Element) -> str | None:
    parts = [f'"{name}":{_scalar(nodes)}' for name, nodes in e.attrs if _content(nodes)]
    return "{" + ",".join(parts) + "}" if parts else None


def _value(e: Element, *, separate: bool, container: bool, data: bool = False) -> str:
    """An element's JSON value; ``data``: of a Data element, whose emptiness is an empty string and whose attributes don't show."""
    has_elements = any(isinstance(n, Element) for n in e.children)
    has_text = _content(e.children)
    attrs = None if separate or data else _attributes(e)
    if not has_elements and attrs is None:
        if not has_text:
            return '""' if data else "null"
        return _scalar(e.children)
    members: list[str] = []
    if attrs is not None:
        members.append(f'"#attributes":{attrs}')
    if has_text:
        members.append(f'"#text":{_scalar(e.children)}')
    members += _members([n for n in e.children if isinstance(n, Element)], separate=separate, container=container)
    return "{" + ",".join(members) + "}"


def _name_of(e: Element) -> list | None:
    nodes = next((nodes for name, nodes in e.attrs if name == "Name"), None)
    return nodes if nodes and _content(nodes) else None


def _members(children: list[Element], *, separate: bool, container: bool) -> list[str]:
    out: list[str] = []
    seen: dict[str, int] = {}
    fields = [c for c in children if c.name == "Data"] if container else []
    named = any(_name_of(c) for c in fields)
    shown = False
    for c in children:
        if container and c.name == "Data":
            if named:
                if name := _name_of(c):
                    out.append(f'"{_text(name)}":{_value(c, separate=separate, container=False, data=True)}')
            elif not shown:
                shown = True
                items = [_value(d, separate=separate, container=False, data=True) for d in fields]
                out.append('"Data":{"#text":' + (items[0] if len(items) == 1 else f"[{','.join(items)}]") + "}")
            continue
        n = seen.get(c.name, 0)
        seen[c.name] = n + 1
        key = f"{c.name}_{n}" if n else c.name
        inner = c.name in ("EventData", "UserData")
        if separate:
            attrs = _attributes(c)
            if attrs is not None:
                out.append(f'"{key}_attributes":{attrs}')
            if attrs is None or _content(c.children) or any(isinstance(x, Element) for x in c.children):
                out.append(f'"{key}":{_value(c, separate=True, container=inner)}')
        else:
            out.append(f'"{key}":{_value(c, separate=False, container=inner)}')
    return out


def to_json(root: Element, *, separate: bool = False) -> str:
    """Compact JSON. Two Data of one name give a key twice; see ``single_keys``."""
    if separate:
        attrs = _attributes(root)
        head = f'"{root.name}_attributes":{attrs},' if attrs is not None else ""
        return f'{{{head}"{root.name}":{_value(root, separate=True, container=False)}}}'
    return f'{{"{root.name}":{_value(root, separate=False, container=False)}}}'


class _Repeated(Exception):
    pass


def _unique(pairs: list[tuple[str, object]]) -> dict:
    made = dict(pairs)
    if len(made) != len(pairs):
        raise _Repeated
    return made


def parsed(text: str) -> tuple[str, object]:
    """JSON in which a repeated key stands once, with its last value; and its value. One
    parse is enough unless a key repeats."""
    try:
        return text, json.loads(text, object_pairs_hook=_unique)
    except _Repeated:
        value = json.loads(text)
        return json.dumps(value, ensure_ascii=False, separators=(",", ":")), value


def single_keys(text: str) -> str:
    return parsed(text)[0]


def type_of(value: object) -> str:
    return V.NAMES[V.STRING] if isinstance(value, str) else V.type_name(value.kind)
