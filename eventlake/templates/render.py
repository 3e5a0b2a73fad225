"""Provider templates as XML: with placeholders shown, or with values filled in."""

from __future__ import annotations

from ..binxml import values as V
from ..binxml.render import to_xml
from ..binxml.tree import Decoder, Element, Placeholder, expanded, inline_name, resolved
from ..binxml.values import Value


def parse_body(body: bytes, codec: str = "windows-1252") -> Element:
    return Decoder(body, inline_name, codec).parse(0, len(body), template=True, depth=0)


def _shown(e: Element, names: list[str | None]) -> Element:
    def node(n: object) -> object:
        if isinstance(n, Placeholder):
            name = names[n.index] if n.index < len(names) else None
            return f"{{sub:{n.index}:{name}}}" if name else f"{{sub:{n.index}}}"
        return _shown(n, names) if isinstance(n, Element) else n

    return Element(e.name, [(k, [node(n) for n in nodes]) for k, nodes in e.attrs], [node(n) for n in e.children])


def with_placeholders(body: bytes, names: list[str | None] = (), *, indent: bool = True) -> str:
    """``{sub:N}``, or ``{sub:N:name}`` where the template names its items."""
    return to_xml(_shown(parse_body(body), list(names)), indent=indent, declaration=False)


def with_values(body: bytes, values: list[object], *, indent: bool = True) -> str:
    """The template with values (texts or typed values) filled in; nested fragments are empty."""
    plain = [Value(V.NULL, None) if isinstance(v, Value) and v.kind == V.BINXML else v for v in values]
    return to_xml(expanded(resolved(parse_body(body), plain))[0], indent=indent, declaration=False)


def json_values(items: list[object]) -> list[object]:
    """JSON scalars as substitution values."""
    out: list[object] = []
    for x in items:
        if x is None:
            out.append(Value(V.NULL, None))
        elif isinstance(x, bool):
            out.append(Value(V.BOOL, x))
        elif isinstance(x, int):
            out.append(Value(V.INT64 if x < 0 else V.UINT64, x))
        elif isinstance(x, float):
            out.append(Value(V.REAL64, x))
        elif isinstance(x, str):
            out.append(x)
        else:
            raise ValueError(f"no substitution value: {x!r}")
    return out
