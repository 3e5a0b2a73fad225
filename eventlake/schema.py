"""Schemas of the relational model and of decoded logs."""

from __future__ import annotations

from pyspark.sql import types as T

#: The one relational table of the viewer model.
LOGS = T.StructType(
    [
        T.StructField("EventID", T.IntegerType()),
        T.StructField("Level", T.IntegerType()),
        T.StructField("Provider", T.StringType()),
        T.StructField("Channel", T.StringType()),
        T.StructField("Raw", T.StringType()),
    ]
)

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("offset", T.LongType())])

#: A decoded record; a damaged one has ``error`` and no data.
RECORDS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("record_seq", T.LongType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        *LOGS.fields,
        T.StructField("xml", T.StringType()),
        T.StructField("error", ERROR),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("chunk_ordinal", T.IntegerType()),
        *(T.StructField(n, T.LongType()) for n in ("first_record_number", "last_record_number", "first_record_id", "last_record_id", "header_size", "last_record_offset", "free_space_offset", "events_crc", "flags", "header_crc", "record_count")),
        T.StructField("header_ok", T.BooleanType()),
        T.StructField("events_ok", T.BooleanType()),
        T.StructField("error", ERROR),
    ]
)

#: Of each chunk, its good records as an Arrow IPC stream with the columns of RECORDS.
ARROW = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("ipc", T.BinaryType()),
        T.StructField("error", ERROR),
    ]
)

#: Of each chunk what is kept to skip it or to count by it. ``untimed``: good records without a time.
STATES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        *(T.StructField(n, T.LongType()) for n in ("records", "errors", "untimed", "first_id", "last_id")),
        T.StructField("first_ts", T.TimestampType()),
        T.StructField("last_ts", T.TimestampType()),
        T.StructField("facets", T.ArrayType(T.StructType([T.StructField("facet", T.StringType()), T.StructField("key", T.StringType()), T.StructField("cnt", T.LongType())]))),
        T.StructField("error", ERROR),
    ]
)

HEADERS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("record_seq", T.LongType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("offset", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("error", ERROR),
    ]
)

FILES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        *(T.StructField(n, T.LongType()) for n in ("first_chunk", "last_chunk", "next_record_id", "header_size", "minor", "major", "header_block_size", "chunk_count", "flags", "checksum")),
        T.StructField("is_dirty", T.BooleanType()),
        T.StructField("is_full", T.BooleanType()),
        T.StructField("error", ERROR),
    ]
)

INSTANCES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("instance", T.IntegerType()),
        T.StructField("template_id", T.LongType()),
        T.StructField("def_offset", T.LongType()),
        T.StructField("guid", T.StringType()),
        T.StructField("substitutions", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("error", ERROR),
    ]
)
