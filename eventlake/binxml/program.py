"""Rendering by shape: a template's output for given kinds of values, as text with holes.

What a template renders to depends on its values only through their kinds and whether
they're empty, apart from the values' own text. So the first record of a shape is
rendered by the plain renderer with a mark in place of each value, and the result is
cut at the marks; later records of the shape fill the holes. Shapes with arrays of two
or more items or nested fragments, and templates whose own text has a mark, take the
plain way, as does anything that isn't a single template instance.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from . import values as V
from .render import ATTRIBUTE_ESCAPES, TEXT_ESCAPES, Hole, drop_lone, escape_json, to_json, to_xml
from .tree import Element, is_empty, resolved
from .values import Value

_STRING_OR_MARK = re.compile('"(?:[^"\\\\]|\\\\.)*"|\ue000([0-9]+)[at]\ue001')
_MARK = re.compile("\ue000([0-9]+)([at])\ue001")


@dataclass(slots=True)
class Program:
    """Literals around (slot, attribute) holes. ``unique``: no key repeats and none has a hole."""

    literals: list[str]
    holes: list[tuple[int, bool]]
    unique: bool
    #: Of JSON: a document with marks for values, from which the viewer's columns are told.
    marked: object = None
    columns: tuple | None = None
    parts: list[str] | None = None

    def joined(self, texts: list[str]) -> str:
        """The literals around the holes' texts."""
        if self.parts is None:
            self.parts = [""] * (2 * len(self.holes) + 1)
            self.parts[::2] = self.literals
        out = self.parts.copy()
        out[1::2] = texts
        return "".join(out)

    def fill(self, texts: list[tuple[str, str]]) -> str:
        out = [self.literals[0]]
        for (slot, attribute), literal in zip(self.holes, self.literals[1:], strict=True):
            out.append(texts[slot][attribute])
            out.append(literal)
        return "".join(out)


def shape_of(values: list[tuple[int, object]]) -> tuple | None:
    """Kinds and emptiness of values; None if the plain way is needed."""
    out = []
    for _, v in values:
        if isinstance(v, str):
            out.append(V.STRING if v else -1)
        elif v.kind & V.ARRAY and len(v.data) > 1 or v.kind == V.BINXML and v.data:
            return None
        else:
            out.append(-2 - v.kind if v.empty else v.kind)
    return tuple(out)


def _marked(template: Element, values: list[tuple[int, object]]) -> Element:
    return resolved(template, [v if is_empty(v) or isinstance(v, Value) and v.empty else Hole(V.STRING if isinstance(v, str) else v.kind, i) for i, (_, v) in enumerate(values)])


def compiled(template: Element, values: list[tuple[int, object]], *, xml: bool, separate: bool, indent: bool) -> Program | None:
    """The program of these values' shape; None if the template's own text has a mark."""
    tree = _marked(template, values)
    text = to_xml(tree, indent=indent) if xml else to_json(tree, separate=separate)
    parts = _MARK.split(text)
    literals = parts[::3]
    if any("\ue000" in p or "\ue001" in p for p in literals):
        return None
    unique, marked = False, None
    if not xml:
        found: list[bool] = []

        def hook(pairs: list[tuple[str, object]]) -> dict:
            found.append(len(dict(pairs)) == len(pairs) and not any("\ue000" in k for k, _ in pairs))
            return dict(pairs)

        json.loads(re.sub('(?<!")\ue000[0-9]+[at]\ue001', "0", text), object_pairs_hook=hook)
        unique = all(found)
        if unique:
            # A mark outside of any string is a bare number or boolean.
            marked = json.loads(_STRING_OR_MARK.sub(lambda m: m[0] if m[1] is None else f'"\ue000{m[1]}b\ue001"', text))
    return Program(literals, [(int(s), c == "a") for s, c in zip(parts[1::3], parts[2::3], strict=True)], unique, marked)


def json_texts(values: list[tuple[int, object]]) -> list[tuple[str, str]]:
    out = []
    for _, v in values:
        text = escape_json(v) if isinstance(v, str) else str(v.data) if V.INT8 <= v.kind <= V.UINT64 else "" if v.kind == V.NULL or v.empty else escape_json(v.text())
        out.append((text, text))
    return out


def xml_texts(values: list[tuple[int, object]]) -> list[tuple[str, str]]:
    out = []
    for _, v in values:
        text = v if isinstance(v, str) else "" if v.kind == V.NULL or v.empty else v.text()
        text = drop_lone(text)
        out.append((text.translate(TEXT_ESCAPES), text.translate(ATTRIBUTE_ESCAPES)))
    return out
