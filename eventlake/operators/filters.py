"""Filters over the logs table, as one Column expression.

Clauses are and-ed, the values of a clause are or-ed. An exclude clause drops rows
that lack the field, since null is neither in nor out of a list.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import event_time
from .columns import Columns, event_data


@dataclass(frozen=True)
class Filters:
    provider: tuple[str, ...] = ()
    channel: tuple[str, ...] = ()
    level: tuple[int | str, ...] = ()
    event_id: tuple[int | str, ...] = ()
    event_data: dict[str, Sequence[str]] = field(default_factory=dict)
    event_data_exclude: dict[str, Sequence[str]] = field(default_factory=dict)
    search: str = ""
    column_equals: dict[str, Sequence[str]] = field(default_factory=dict)
    #: Unit of time buckets that ``column_equals`` values of a time column stand for; None compares text.
    time_unit: str | None = None
    time_range: tuple[datetime | None, datetime | None] | None = None

    def toggle(self, name: str, value: object, key: str | None = None) -> Filters:
        """Add a value to a clause, or take it out if it's there."""
        now = getattr(self, name)
        if key is None:
            return replace(self, **{name: tuple(v for v in now if v != value) if value in now else (*now, value)})
        old = tuple(now.get(key, ()))
        new = tuple(v for v in old if v != value) if value in old else (*old, value)
        return replace(self, **{name: {k: v for k, v in {**now, key: new}.items() if v}})

    def update(self, **changes: object) -> Filters:
        return replace(self, **changes)

    def clear(self) -> Filters:
        return Filters()

    def without(self, *, clause: str | None = None, column: str | None = None) -> Filters:
        """The filters without a clause, or without one column of ``column_equals``."""
        if clause:
            return replace(self, **{clause: type(getattr(self, clause))()})
        return replace(self, column_equals={k: v for k, v in self.column_equals.items() if k != column})

    def describe(self) -> list[str]:
        """A line for each active clause; ¬ marks exclusion."""
        out = [f"{name}: {v}" for name in ("provider", "channel", "level", "event_id") for v in getattr(self, name)]
        out += [f"{k}: {v}" for k, vs in self.event_data.items() for v in vs]
        out += [f"¬{k}: {v}" for k, vs in self.event_data_exclude.items() for v in vs]
        out += [f"{k}: {v}" for k, vs in self.column_equals.items() for v in vs]
        return [*out, *([f"search: {self.search}"] if self.search.strip() else [])]

    def condition(self, columns: Columns = Columns(), ts: Column | None = None, data: Column | None = None) -> Column:
        """The clauses as one expression. ``ts`` is the table's own time column if it has one: time
        clauses then compare it, so that they can be pushed into a scan; else the time in Raw is read.
        ``data`` likewise is a map of the event data, which is else read from Raw."""
        parts: list[Column] = []
        if self.provider:
            parts.append(F.col("Provider").isin(*self.provider))
        if self.channel:
            parts.append(F.col("Channel").isin(*self.channel))
        if self.level:
            parts.append(F.col("Level").isin(*map(int, self.level)))
        if self.event_id:
            parts.append(F.col("EventID").isin(*map(int, self.event_id)))
        parts += [event_data(k, data).expr().isin(*vs) for k, vs in self.event_data.items() if vs]
        parts += [~event_data(k, data).expr().isin(*vs) for k, vs in self.event_data_exclude.items() if vs]
        if self.search.strip():
            parts.append(searched(self.search))
        for id, values in self.column_equals.items():
            spec = columns.get(id)
            if spec is None or not values:
                continue
            if spec.temporal and self.time_unit:
                time = ts if ts is not None and spec.id == "time" else event_time(spec.expr())
                parts.append(F.date_trunc(self.time_unit, time).isin(*[F.lit(v).cast("timestamp") for v in values]))
            else:
                parts.append(spec.expr().cast("string").isin(*map(str, values)))
        if self.time_range:
            time = event_time(columns.get("time").expr()) if ts is None else ts
            low, high = self.time_range
            parts += [time >= F.lit(low)] if low else []
            parts += [time <= F.lit(high)] if high else []
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def searched(term: str) -> Column:
    """Provider, channel or event id contain the term; ``%`` and ``_`` are wild, the backslash isn't."""
    pattern = f"%{term.lower().replace(chr(92), chr(92) * 2)}%"
    return F.lower("Provider").like(pattern) | F.lower("Channel").like(pattern) | F.col("EventID").cast("string").like(pattern)


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """``a-b,c`` to inclusive ranges; ValueError if malformed."""
    out = []
    for part in text.split(","):
        if not re.fullmatch(r"\d+(-\d+)?", part.strip()):
            raise ValueError(f"expected ranges such as 1-5,9; found {text!r}")
        low, _, high = part.strip().partition("-")
        out.append((int(low), int(high or low)))
    return out


def in_ranges(id: Column, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [id.between(low, high) for low, high in ranges], F.lit(False))


def facet_search(value: Column, term: str) -> Column:
    """Case-blind substring of a facet's shown value."""
    return F.contains(F.lower(value.cast("string")), F.lit(term.lower()))
