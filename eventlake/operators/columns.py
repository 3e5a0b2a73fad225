"""Columns of the viewer table: a registry of expressions over the logs table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SYSTEM = "$.Event.System."


@dataclass(frozen=True)
class ColumnSpec:
    """A shown column: an id, a header, and an expression over the logs table. ``system`` gives the
    same from the System object, once that has been read from Raw (``SYSTEM``)."""

    id: str
    header: str
    expr: Callable[[], Column]
    temporal: bool = False
    system: Callable[[Column], Column] | None = None


def _raw(*paths: str) -> Callable[[], Column]:
    found = lambda: [F.get_json_object("Raw", p) for p in paths]
    return lambda: F.coalesce(*found()) if len(paths) > 1 else found()[0]


#: What the viewer's columns need of the System object: scalars as their JSON text.
SYSTEM = "TimeCreated_attributes struct<SystemTime:string>, TimeCreated string, Task string, Computer string, Opcode string, Keywords string, Security string, Security_attributes struct<UserID:string>"


def system_of(raw: Column) -> Column:
    """The System object of Raw: one pass over the record, and one over that object."""
    return F.from_json(F.get_json_object(raw, "$.Event.System"), SYSTEM)


def _one(name: str) -> dict:
    return {"expr": _raw(_SYSTEM + name), "system": lambda s: s[name]}


def _inner(s: Column, name: str, key: str) -> Column:
    return F.get_json_object(s[name], f"$.{key}")


#: ``user`` reads the path that logs with attributes apart don't have; ``user_sid`` reads both.
DEFAULT = (
    ColumnSpec("level", "Level", lambda: F.col("Level")),
    ColumnSpec("time", "Date & Time", _raw(_SYSTEM + "TimeCreated_attributes.SystemTime", _SYSTEM + "TimeCreated.SystemTime"), True, lambda s: F.coalesce(s["TimeCreated_attributes"]["SystemTime"], _inner(s, "TimeCreated", "SystemTime"))),
    ColumnSpec("provider", "Source", lambda: F.col("Provider")),
    ColumnSpec("eventId", "Event ID", lambda: F.col("EventID")),
    ColumnSpec("task", "Task", **_one("Task")),
    ColumnSpec("user", "User", _raw(_SYSTEM + "Security.UserID"), system=lambda s: _inner(s, "Security", "UserID")),
    ColumnSpec("computer", "Computer", **_one("Computer")),
    ColumnSpec("opcode", "OpCode", **_one("Opcode")),
    ColumnSpec("keywords", "Keywords", **_one("Keywords")),
)
USER_SID = ColumnSpec("user_sid", "User SID", _raw(_SYSTEM + "Security_attributes.UserID", _SYSTEM + "Security.UserID"), system=lambda s: F.coalesce(s["Security_attributes"]["UserID"], _inner(s, "Security", "UserID")))


def _field(name: str) -> Callable[[], Column]:
    """One field of EventData, whatever its name. Spark's JSON paths can't quote every name, so one
    that could be read as more than a name is looked up in the object itself."""
    if name.replace("_", "").isalnum():
        return _raw(f"$.Event.EventData.{name}")
    data = lambda: F.from_json(F.get_json_object("Raw", "$.Event.EventData"), "map<string,string>")
    return lambda: data()[name]


def event_data(name: str, data: Column | None = None) -> ColumnSpec:
    """A field of EventData; ``data`` is a map of it where the table has one."""
    return ColumnSpec(f"eventData.{name}", name, _field(name) if data is None else lambda: data[name])


def shown(df: DataFrame, specs: Sequence[ColumnSpec], *more: str) -> DataFrame:
    """Columns of a registry and further ones. The System object is read from Raw once for all of
    them, or taken as it is from a table that has it (``system``)."""
    if not any(s.system for s in specs):
        return df.select(*[s.expr().alias(s.id) for s in specs], *more)
    stored = "system" in df.columns and isinstance(df.schema["system"].dataType, StructType)
    rows = df if stored else df.withColumn("_system", system_of(F.col("Raw")))
    at = F.col("system" if stored else "_system")
    return rows.select(*[(s.system(at) if s.system else s.expr()).alias(s.id) for s in specs], *more)


@dataclass(frozen=True)
class Columns:
    """An immutable list of columns; ids are unique."""

    specs: tuple[ColumnSpec, ...] = field(default=DEFAULT)

    def get(self, id: str) -> ColumnSpec | None:
        return next((s for s in self.specs if s.id == id), None)

    def add(self, spec: ColumnSpec) -> Columns:
        return self if self.get(spec.id) else Columns((*self.specs, spec))

    def remove(self, id: str) -> Columns:
        return Columns(tuple(s for s in self.specs if s.id != id))
