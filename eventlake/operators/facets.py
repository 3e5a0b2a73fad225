"""Facet counts and adaptive time histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ColumnSpec, Columns
from .filters import Filters
from .logs import matching

TOP = 250
FACETS = ("level", "provider", "channel", "event_id")
_KEYS = {"level": "Level", "provider": "Provider", "channel": "Channel", "event_id": "EventID"}


def facet(logs: DataFrame, name: str, filters: Filters = Filters(), *, columns: Columns = Columns()) -> DataFrame:
    """(key, cnt) of a built-in facet. Only ``event_id`` ignores its own clause; a null key is empty text."""
    kept = filters.without(clause="event_id") if name == "event_id" else filters
    key = F.coalesce(F.col(_KEYS[name]).cast("string"), F.lit(""))
    return matching(logs, kept, columns).groupBy(key.alias("key")).agg(F.count("*").alias("cnt"))


def facet_counts(logs: DataFrame, filters: Filters = Filters(), *, columns: Columns = Columns()) -> DataFrame:
    """(facet, key, cnt) of all four facets in one scan: each row is dealt to the facets
    whose clauses it meets, and counted before the shuffle."""
    own = filters.condition(columns)
    loose = filters.without(clause="event_id").condition(columns)
    deal = F.array(*[F.struct(F.lit(name).alias("facet"), F.coalesce(F.col(_KEYS[name]).cast("string"), F.lit("")).alias("key"), (loose if name == "event_id" else own).alias("met")) for name in FACETS])
    return logs.where(loose).select(F.explode(deal).alias("f")).where("f.met").groupBy("f.facet", "f.key").agg(F.count("*").alias("cnt"))


def column_facet(logs: DataFrame, spec: ColumnSpec, filters: Filters = Filters(), *, limit: int | None = TOP, columns: Columns = Columns()) -> DataFrame:
    """(v, cnt) of a column, most frequent first, then by value. The column's own
    ``column_equals`` clause is left out, the built-in clauses aren't."""
    counted = matching(logs, filters.without(column=spec.id), columns).groupBy(spec.expr().alias("v")).agg(F.count("*").alias("cnt"))
    ordered = counted.orderBy(F.desc("cnt"), F.asc_nulls_first("v"))
    return ordered if limit is None else ordered.limit(limit)


def time_unit(low: Column, high: Column) -> Column:
    """Unit of buckets for a span: minute up to 2 h, hour to 48 h, day to 90 d, week to 365 d, else month."""
    span = F.unix_millis(high.cast("timestamp")) - F.unix_millis(low.cast("timestamp"))
    hour = 3_600_000
    return F.when(span <= 2 * hour, "minute").when(span <= 48 * hour, "hour").when(span <= 90 * 24 * hour, "day").when(span <= 365 * 24 * hour, "week").otherwise("month")


def time_facet(logs: DataFrame, time: Column, filters: Filters = Filters(), *, limit: int | None = TOP, columns: Columns = Columns()) -> DataFrame:
    """(v, cnt) of time buckets, the earliest first; the unit follows the span of the matching rows.

    The span is one row, so it joins by broadcast and the plan stays lazy; the unit is
    the same for all rows and picks among five truncations inside code generation.
    """
    rows = matching(logs, filters.without(column="time"), columns).select(time.alias("t")).where(F.col("t").isNotNull())
    span = rows.agg(F.min("t").alias("low"), F.max("t").alias("high")).select(time_unit(F.col("low"), F.col("high")).alias("unit"))
    cut = F.date_trunc("month", "t")
    for unit in ("week", "day", "hour", "minute"):
        cut = F.when(F.col("unit") == unit, F.date_trunc(unit, "t")).otherwise(cut)
    counted = rows.crossJoin(F.broadcast(span)).groupBy(F.date_format(cut, "yyyy-MM-dd HH:mm").alias("v")).agg(F.count("*").alias("cnt"))
    ordered = counted.orderBy("v")
    return ordered if limit is None else ordered.limit(limit)


def buckets(records: DataFrame) -> DataFrame:
    """(facet, key, cnt) of whole files as the decoder counts them: a key counts only where
    Raw has it; levels keep their JSON text; an EventID object gives its ``#text``, else its JSON."""
    raw = F.try_parse_json("Raw")
    get = lambda path, kind="string": F.try_variant_get(raw, path, kind)
    level = F.to_json(F.try_variant_get(raw, "$.Event.System.Level", "variant"))
    event = F.get_json_object("Raw", "$.Event.System.EventID")
    text = F.get_json_object("Raw", "$.Event.System.EventID['#text']")
    provider = F.coalesce(get("$.Event.System.Provider.Name"), get("$.Event.System.Provider_attributes.Name"))
    deal = F.array(
        F.struct(F.lit("level").alias("facet"), level.alias("key")),
        F.struct(F.lit("provider").alias("facet"), provider.alias("key")),
        F.struct(F.lit("channel").alias("facet"), get("$.Event.System.Channel").alias("key")),
        F.struct(F.lit("event_id").alias("facet"), F.coalesce(text, event).alias("key")),
    )
    return records.select(F.explode(deal).alias("f")).where("f.key IS NOT NULL").groupBy("f.facet", "f.key").agg(F.count("*").alias("cnt"))
