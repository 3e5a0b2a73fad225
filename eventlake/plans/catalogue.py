"""Queries over whole tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import arrays, facets, templates
from ..operators import logs as L
from ..operators.columns import DEFAULT, Columns, event_data, shown
from ..operators.filters import Filters, facet_search, in_ranges, parse_ranges
from .view import logs, sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SHOWN = ["record_seq", "EventID", "Level", "Provider", "Channel", "Raw"]
SHOWN_SQL = ", ".join(SHOWN)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


def filtered(name: str, filters: Filters, where: str, columns: Columns = Columns()) -> None:
    """A query of all rows that a filter keeps."""
    query(name, sql(f"SELECT {SHOWN_SQL} FROM logs WHERE {where}"))(lambda spark, sf: L.matching(logs(spark, sf), filters, columns).select(*SHOWN))


#: The CRC-32 of each byte as a list: eight times, shift right and add the polynomial if a bit falls out.
CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (WITH RECURSIVE t(i, c, n) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, n + 1 FROM t WHERE n < 8) SELECT i, c FROM t WHERE n = 8))"
K = "json_extract_string(Raw, '$.Event.EventData.k')"

# Scans and counts


@query("logs_scan", sql(f"SELECT {SHOWN_SQL} FROM logs"))
def logs_scan(spark, sf):
    return logs(spark, sf).select(*SHOWN)


@query("logs_count", sql("SELECT count(*) AS cnt FROM logs"))
def logs_count(spark, sf):
    return L.count_records(logs(spark, sf))


@query("count_filtered", sql("SELECT count(*) AS cnt FROM logs WHERE Level IN (2, 3) AND Channel IN ('Security')"))
def count_filtered(spark, sf):
    return L.count_records(logs(spark, sf), Filters(level=(2, 3), channel=("Security",)))


@query("count_empty", sql("SELECT count(*) AS cnt FROM logs WHERE Provider IN ('none')"))
def count_empty(spark, sf):
    return L.count_records(logs(spark, sf), Filters(provider=("none",)))


# Filters

filtered("filter_provider", Filters(provider=("Provider-error", "Provider-click")), "Provider IN ('Provider-error', 'Provider-click')")
filtered("filter_channel", Filters(channel=("System",)), "Channel IN ('System')")
filtered("filter_level", Filters(level=("2", 3)), "Level IN (2, 3)")
filtered("filter_event_id", Filters(event_id=(4601, "4650")), "EventID IN (4601, 4650)")
filtered("eventdata_include", Filters(event_data={"k": ["5", "7"], "UserId": [str(i) for i in range(40)]}), f"{K} IN ('5', '7') AND json_extract_string(Raw, '$.Event.EventData.UserId') IN ({', '.join(repr(str(i)) for i in range(40))})")
filtered("eventdata_exclude", Filters(event_data_exclude={"k": ["5", "7"]}), f"{K} NOT IN ('5', '7')")
filtered("eventdata_numeric", Filters(event_data={"k": ["42"]}), f"{K} IN ('42')")
filtered("search_term", Filters(search="ERROR"), "lower(Provider) LIKE '%error%' OR lower(Channel) LIKE '%error%' OR CAST(EventID AS TEXT) LIKE '%error%'")
filtered("search_wildcard", Filters(search="s_c%y"), "lower(Provider) LIKE '%s_c%y%' OR lower(Channel) LIKE '%s_c%y%' OR CAST(EventID AS TEXT) LIKE '%s_c%y%'")
filtered("search_backslash", Filters(search="\\s"), "lower(Provider) LIKE '%\\s%' OR lower(Channel) LIKE '%\\s%' OR CAST(EventID AS TEXT) LIKE '%\\s%'")
filtered("search_number", Filters(search="465"), "lower(Provider) LIKE '%465%' OR lower(Channel) LIKE '%465%' OR CAST(EventID AS TEXT) LIKE '%465%'")
filtered("column_equals", Filters(column_equals={"task": ["3", "5"], "level": ["2", "x"], "unknown": ["1"], "computer": []}), "json_extract_string(Raw, '$.Event.System.Task') IN ('3', '5') AND CAST(Level AS TEXT) IN ('2', 'x')")
filtered("column_equals_event_data", Filters(column_equals={"eventData.k": ["9"]}), f"{K} IN ('9')", Columns().add(event_data("k")))
filtered("column_equals_time", Filters(column_equals={"time": ["2024-01-03 05:00", "2024-01-10 17:00"]}, time_unit="hour"), "time_bucket(INTERVAL '1 hour', ts) IN (TIMESTAMP '2024-01-03 05:00:00', TIMESTAMP '2024-01-10 17:00:00')")
filtered("column_equals_time_text", Filters(column_equals={"time": ["2024-01-01T00:00:07.000000Z"]}), "json_extract_string(Raw, '$.Event.System.TimeCreated_attributes.SystemTime') IN ('2024-01-01T00:00:07.000000Z')")
filtered("combined_filters", Filters(level=(2, 4), channel=("Security", "System"), event_data_exclude={"k": ["1"]}, search="provider"), f"Level IN (2, 4) AND Channel IN ('Security', 'System') AND {K} NOT IN ('1') AND (lower(Provider) LIKE '%provider%' OR lower(Channel) LIKE '%provider%' OR CAST(EventID AS TEXT) LIKE '%provider%')")
filtered("time_range", Filters(time_range=(datetime(2024, 1, 5), datetime(2024, 1, 6, 12))), "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'")


@query("record_id_ranges", sql(f"SELECT {SHOWN_SQL} FROM logs WHERE record_seq BETWEEN 10 AND 25 OR record_seq BETWEEN 100 AND 100 OR record_seq BETWEEN 900 AND 950"))
def record_id_ranges(spark, sf):
    return logs(spark, sf).where(in_ranges(F.col("record_seq"), parse_ranges("10-25,100,900-950"))).select(*SHOWN)


@query("record_by_id", sql(f"SELECT {SHOWN_SQL} FROM logs WHERE record_seq = 77"))
def record_by_id(spark, sf):
    return L.record_by_id(logs(spark, sf).withColumn("record_id", F.col("record_seq")), 77).select(*SHOWN)


# Facets

WITH_FILTER = Filters(event_id=tuple(range(4600, 4620)), channel=("Security", "System"))
FACET_WHERE = {"event_id": "Channel IN ('Security', 'System')"}
FACET_KEY = {"level": "Level", "provider": "Provider", "channel": "Channel", "event_id": "EventID"}


def _facet_sql(name: str) -> str:
    where = FACET_WHERE.get(name, f"Channel IN ('Security', 'System') AND EventID IN ({', '.join(map(str, range(4600, 4620)))})")
    return f"SELECT coalesce(CAST({FACET_KEY[name]} AS TEXT), '') AS key, count(*) AS cnt FROM logs WHERE {where} GROUP BY 1"


for _name in facets.FACETS:
    query(f"facet_{_name}", sql(_facet_sql(_name)))(lambda spark, sf, name=_name: facets.facet(logs(spark, sf), name, WITH_FILTER))


@query("facet_all", sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS facet, * FROM ({_facet_sql(n)})" for n in facets.FACETS) + ")"))
def facet_all(spark, sf):
    return facets.facet_counts(logs(spark, sf), WITH_FILTER)


@query("facet_provider_top", sql("SELECT Provider AS v, count(*) AS cnt FROM logs WHERE Level IN (2, 3) GROUP BY 1 ORDER BY cnt DESC, v LIMIT 250"))
def facet_provider_top(spark, sf):
    return facets.column_facet(logs(spark, sf), Columns().get("provider"), Filters(level=(2, 3)))


@query("column_facet_task", sql("SELECT json_extract_string(Raw, '$.Event.System.Task') AS v, count(*) AS cnt FROM logs WHERE Level IN (2) GROUP BY 1 ORDER BY cnt DESC, v LIMIT 250"))
def column_facet_task(spark, sf):
    return facets.column_facet(logs(spark, sf), Columns().get("task"), Filters(level=(2,), column_equals={"task": ["1"]}))


@query("column_facet_eventdata", sql(f"SELECT {K} AS v, count(*) AS cnt FROM logs GROUP BY 1 ORDER BY cnt DESC, v NULLS FIRST LIMIT 20"))
def column_facet_eventdata(spark, sf):
    return facets.column_facet(logs(spark, sf), event_data("k"), limit=20)


@query("facet_value_search", sql("SELECT Provider AS v, count(*) AS cnt FROM logs WHERE contains(lower(Provider), 'ic') GROUP BY 1"))
def facet_value_search(spark, sf):
    return facets.column_facet(logs(spark, sf), Columns().get("provider"), limit=None).where(facet_search(F.col("v"), "IC"))


@query("buckets_all", sql("SELECT 'event_id' AS facet, json_extract_string(Raw, '$.Event.System.EventID') AS key, count(*) AS cnt FROM logs GROUP BY 2"))
def buckets_all(spark, sf):
    return facets.buckets(logs(spark, sf))


# Time histograms

UNIT_SQL = """CASE WHEN datediff('millisecond', low, high) <= 7200000 THEN 'minute' WHEN datediff('millisecond', low, high) <= 172800000 THEN 'hour'
  WHEN datediff('millisecond', low, high) <= 7776000000 THEN 'day' WHEN datediff('millisecond', low, high) <= 31536000000 THEN 'week' ELSE 'month' END"""


def _time_sql(source: str, t: str, where: str) -> str:
    return f""", picked AS (SELECT {t} AS t FROM {source} WHERE {where}), span AS (SELECT min(t) AS low, max(t) AS high FROM picked)
SELECT strftime(date_trunc({UNIT_SQL}, t), '%Y-%m-%d %H:%M') AS v, count(*) AS cnt FROM picked, span GROUP BY 1 ORDER BY 1 LIMIT 250"""


def _time_query(name: str) -> None:
    query(name, sql(_time_sql("logs", "ts", "true")))(lambda spark, sf: facets.time_facet(logs(spark, sf), F.col("ts")))


_time_query("time_facet_day")


def _scaled_time_query(name: str, hours: int) -> None:
    """All events, their times since the first divided so that they span ``hours`` at most."""
    wide = hours * 3_600_000_000
    scaled = f""", scaled AS (SELECT make_timestamp(low + (epoch_us(ts) - low) // ratio) AS ts
  FROM logs, (SELECT min(epoch_us(ts)) AS low, greatest((max(epoch_us(ts)) - min(epoch_us(ts)) + {wide - 1}) // {wide}, 1) AS ratio FROM logs))"""

    def run(spark, sf):
        rows = logs(spark, sf).withColumn("ft", S.timestamp_to_filetime(F.col("ts")))
        span = rows.agg(F.min("ft").alias("low"), F.max("ft").alias("high")).selectExpr("low", f"greatest((high - low + {10 * wide - 1}) div {10 * wide}, 1) AS ratio")
        scaled = rows.crossJoin(F.broadcast(span)).withColumn("ft", F.expr("low + (ft - low) div 10 div ratio * 10"))
        return facets.time_facet(scaled, S.filetime_to_timestamp(F.col("ft")))

    query(name, sql(scaled + _time_sql("scaled", "ts", "true")))(run)


_scaled_time_query("time_facet_minute", 1)
_scaled_time_query("time_facet_hour", 24)
_scaled_time_query("time_facet_minute_all", 2)
_scaled_time_query("time_facet_hour_all", 48)


@query("time_facet_from_json", sql(_time_sql("logs", "ts", "Level IN (2)")))
def time_facet_from_json(spark, sf):
    return facets.time_facet(logs(spark, sf), S.event_time(Columns().get("time").expr()), Filters(level=(2,)))


_YEAR = 365 * 24 * 3_600_000_000


@query("time_facet_week", f"""WITH dummy AS (SELECT 1), scaled AS (SELECT make_timestamp(low + (epoch_us(o_orderdate) - low) // ratio) AS t
  FROM orders, (SELECT min(epoch_us(o_orderdate)) AS low, greatest((max(epoch_us(o_orderdate)) - min(epoch_us(o_orderdate)) + {_YEAR - 1}) // {_YEAR}, 1) AS ratio FROM orders))""" + _time_sql("scaled", "t", "true"))
def time_facet_week(spark, sf):
    """All orders, the times since the first divided so that they span a year at most."""
    orders = table(spark, sf, "orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    span = orders.agg(F.min("t").alias("low"), F.max("t").alias("high")).selectExpr("low", f"greatest((high - low + {_YEAR - 1}) div {_YEAR}, 1) AS ratio")
    scaled = orders.crossJoin(F.broadcast(span)).withColumn("t", F.timestamp_micros(F.expr("low + (t - low) div ratio")))
    return facets.time_facet(scaled, F.col("t"))


@query("time_facet_month", "WITH dummy AS (SELECT 1)" + _time_sql("orders", "o_orderdate", "true"))
def time_facet_month(spark, sf):
    return facets.time_facet(table(spark, sf, "orders"), F.col("o_orderdate"))


# Filters as they are set and taken back


@query("filter_toggled", sql(f"SELECT {SHOWN_SQL} FROM logs WHERE Level IN (2, 3) AND Channel IN ('Security')"))
def filter_toggled(spark, sf):
    """Values set and taken back by toggling; other clauses changed, merged and dropped."""
    f = Filters(level=(2,), provider=("none",), column_equals={"task": ["1"]})
    f = f.toggle("level", 4).toggle("level", 3).toggle("level", 4).toggle("event_data", "x", "k").toggle("event_data", "x", "k")
    f = f.update(channel=("Security",)).without(clause="provider").without(column="task")
    return L.matching(logs(spark, sf), f).select(*SHOWN)


@query("filter_lines", sql("SELECT 'level: ' || Level AS line, count(*) AS cnt FROM logs GROUP BY Level UNION ALL SELECT 'provider: ' || Provider, count(*) FROM logs GROUP BY Provider UNION ALL SELECT '¬k: ' || k, count(*) FROM (SELECT " + K + " AS k FROM logs) WHERE k IN ('1', '2') GROUP BY k"))
def filter_lines(spark, sf):
    """A line for each active clause, excluded values marked, with the rows that have its value."""
    rows = logs(spark, sf)
    levels, providers = (tuple(r["key"] for r in facets.facet(rows, name).orderBy("key").limit(facets.TOP).collect()) for name in ("level", "provider"))
    f = Filters(level=levels, provider=providers, event_data_exclude={"k": ["1", "2"]})
    each = F.array(F.concat(F.lit("level: "), F.col("Level").cast("string")), F.concat(F.lit("provider: "), F.col("Provider")), F.concat(F.lit("¬k: "), event_data("k").expr()))
    counts = rows.select(F.explode(each).alias("line")).groupBy("line").agg(F.count("*").alias("cnt"))
    return counts.join(F.broadcast(spark.createDataFrame([(x,) for x in f.describe()], "line string")), "line", "left_semi")


# Pages and columns


@query("page_late", sql("SELECT record_seq, Raw FROM (SELECT * FROM logs ORDER BY record_seq LIMIT 100 OFFSET (SELECT count(*) // 2 FROM logs))"))
def page_late(spark, sf):
    """A page from the middle: rows are counted by range, only those of its range are sorted."""
    rows = logs(spark, sf)
    return L.paged(rows, 100, rows.count() // 2, direct=0).select("record_seq", "Raw")


@query("page_raw", sql("SELECT Raw FROM (SELECT * FROM logs WHERE Level IN (2) ORDER BY record_seq LIMIT 50 OFFSET 100)"))
def page_raw(spark, sf):
    return L.fetch_records(logs(spark, sf), Filters(level=(2,)), limit=50, offset=100)


_DEFAULT_SQL = """Level AS level, json_extract_string(Raw, '$.Event.System.TimeCreated_attributes.SystemTime') AS time, Provider AS provider, EventID AS "eventId",
  json_extract_string(Raw, '$.Event.System.Task') AS task, json_extract_string(Raw, '$.Event.System.Security.UserID') AS "user", json_extract_string(Raw, '$.Event.System.Computer') AS computer,
  json_extract_string(Raw, '$.Event.System.Opcode') AS opcode, json_extract_string(Raw, '$.Event.System.Keywords') AS keywords"""


@query("page_tabular", sql(f"SELECT {_DEFAULT_SQL}, Raw FROM (SELECT * FROM logs ORDER BY record_seq LIMIT 4000 OFFSET 400)"))
def page_tabular(spark, sf):
    return L.fetch_tabular(logs(spark, sf), DEFAULT, offset=400)


@query("page_last", sql("SELECT Raw FROM (SELECT * FROM logs ORDER BY record_seq DESC LIMIT (SELECT count(*) - 300 * ((count(*) - 1) // 300) FROM logs))"))
def page_last(spark, sf):
    rows = logs(spark, sf)
    total = rows.count()
    return L.fetch_records(rows, limit=300, offset=300 * max(0, L.page_count(total, 300) - 1))


@query("default_columns", sql(f"SELECT {_DEFAULT_SQL} FROM logs"))
def default_columns(spark, sf):
    return shown(logs(spark, sf), DEFAULT)


@query("dynamic_column", sql(f"SELECT record_seq, {K} AS k, json_extract_string(Raw, '$.Event.EventData.UserId') AS user_id FROM logs"))
def dynamic_column(spark, sf):
    return logs(spark, sf).select("record_seq", event_data("k").expr().alias("k"), event_data("UserId").expr().alias("user_id"))


@query("level_names", sql("SELECT record_seq, CASE coalesce(Level, 4) WHEN 0 THEN 'LogAlways' WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Information' WHEN 5 THEN 'Verbose' END AS level_name FROM logs"))
def level_names(spark, sf):
    return logs(spark, sf).select("record_seq", S.level_name(F.col("Level")).alias("level_name"))


@query("record_banner", sql("SELECT record_seq, 'Record ' || record_seq || chr(10) || Raw AS text FROM logs"))
def record_banner(spark, sf):
    return logs(spark, sf).select("record_seq", F.concat(F.lit("Record "), F.col("record_seq").cast("string"), F.lit("\n"), F.col("Raw")).alias("text"))


def _chunked(spark, sf):
    return logs(spark, sf).withColumns({"chunk_no": F.floor(F.col("record_seq") / 91).cast("int"), "record_id": F.col("record_seq")})


@query("chunk_info", sql("SELECT CAST(record_seq // 91 AS INTEGER) AS chunk_no, min(record_seq) AS first_record_id, max(record_seq) AS last_record_id, greatest(max(record_seq) - min(record_seq) + 1, 0) AS record_count FROM logs GROUP BY 1"))
def chunk_info(spark, sf):
    return L.chunk_info(_chunked(spark, sf))


@query("chunk_window", sql("SELECT record_seq, CAST(row_in_chunk AS INTEGER) AS row_in_chunk FROM (SELECT record_seq, row_number() OVER (ORDER BY record_seq) - 1 AS row_in_chunk FROM logs WHERE record_seq // 91 = 3) WHERE row_in_chunk >= 10 AND row_in_chunk < 40"))
def chunk_window(spark, sf):
    return L.chunk_window(_chunked(spark, sf), 3, 10, 30).select("record_seq", "row_in_chunk")


# Decode operators in relational form


@query("name_suffix", "SELECT conv_id, turn, CASE WHEN n = 0 THEN role ELSE role || '_' || n END AS key FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations)")
def name_suffix(spark, sf):
    return arrays.suffixed_names(table(spark, sf, "conversations"), ["conv_id"], "role", "turn").select("conv_id", "turn", "key")


@query("positional_data", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, data FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS data, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)")
def positional_data(spark, sf):
    return arrays.positional_data(table(spark, sf, "documents"), F.col("text")).select("doc_id", "pos", "data")


@query("array_expand", "SELECT vec_id, CAST(pos AS INTEGER) AS pos, item FROM (SELECT vec_id, unnest(embedding) AS item, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def array_expand(spark, sf):
    return arrays.expanded(table(spark, sf, "embeddings"), F.col("embedding")).select("vec_id", "pos", "item")


@query("array_cross_expand", "SELECT p_partkey, a, b FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS a, p_name FROM part) t, LATERAL (SELECT unnest(string_split(t.p_name, ' ')) AS b)")
def array_cross_expand(spark, sf):
    return arrays.cross_expanded(table(spark, sf, "part"), F.split("p_type", " "), F.split("p_name", " ")).select("p_partkey", "a", "b")


@query("eventdata_explode", "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS val FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def eventdata_explode(spark, sf):
    return arrays.event_data_fields(table(spark, sf, "events").select("event_id", "props"), F.col("props")).select("event_id", "key", "val")


# Scalars


@query("hex_text", "SELECT l_orderkey, l_linenumber, '0x' || lower(to_hex(l_partkey)) AS hex FROM lineitem")
def hex_text(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.hex_text(F.col("l_partkey")).alias("hex"))


@query("filetime_roundtrip", "SELECT event_id, (epoch_us(ts) + 11644473600000000) * 10 AS filetime, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text FROM events")
def filetime_roundtrip(spark, sf):
    ft = S.timestamp_to_filetime(F.col("ts"))
    return table(spark, sf, "events").select("event_id", ft.alias("filetime")).select("event_id", "filetime", S.timestamp_text(S.filetime_to_timestamp(F.col("filetime"))).alias("text"))


@query("timestamp_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS bucket FROM orders")
def timestamp_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.timestamp_text(F.col("o_orderdate")).alias("text"), S.bucket_text(F.col("o_orderdate")).alias("bucket"))


@query("guid_normalise", "SELECT s_suppkey, lower(trim(trim('  {' || upper(md5(s_name)) || '} '), '{}')) AS guid FROM supplier")
def guid_normalise(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.normalised_guid(F.concat(F.lit("  {"), F.upper(F.md5("s_name")), F.lit("} "))).alias("guid"))


@query("guid_text", "SELECT s_suppkey, upper(m[7:8] || m[5:6] || m[3:4] || m[1:2] || '-' || m[11:12] || m[9:10] || '-' || m[15:16] || m[13:14] || '-' || m[17:20] || '-' || m[21:32]) AS guid FROM (SELECT s_suppkey, md5(s_name) AS m FROM supplier)")
def guid_text(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.guid_text(F.unhex(F.md5("s_name"))).alias("guid"))


@query("crc32_col", f"""WITH steps AS (SELECT {CRC_TABLE} AS tab),
bytes AS (SELECT doc_id, text IS NULL AS none, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents)
SELECT doc_id, CASE WHEN none THEN NULL ELSE xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) END AS crc FROM bytes, steps""")
def crc32_col(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.crc32("text").alias("crc"))


@query("json_escape", "SELECT doc_id, substr(CAST(to_json(text) AS TEXT), 2, length(CAST(to_json(text) AS TEXT)) - 2) AS escaped FROM documents")
def json_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.json_escaped(F.col("text")).alias("escaped"))


@query("xml_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.xml_escaped(F.col("html")).alias("escaped"))


@query("binary_hex", "SELECT p_partkey, hex(p_name) AS hex FROM part")
def binary_hex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.binary_text(F.col("p_name").cast("binary")).alias("hex"))


@query("utf16_roundtrip", "SELECT doc_id, text FROM documents")
def utf16_roundtrip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.utf16_text(F.encode("text", "UTF-16LE")).alias("text"))


@query("array_join", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ',') AS joined FROM part")
def array_join(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.joined(F.split("p_name", " ")).alias("joined"))


@query("name_hash", "SELECT n_nationkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(n_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, c: (h * 65599 + c) % 65536) AS BIGINT) AS hash FROM nation")
def name_hash(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", S.name_hash(F.col("n_name")).alias("hash"))


@query("optional_empty", "SELECT page_id, url IS NULL OR length(url) = 0 AS empty, page_id % 4 & 1 <> 0 AS dirty, nullif(page_id, 3) AS id FROM pages")
def optional_empty(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.is_optional_empty(F.col("url")).alias("empty"), S.has_flag(F.col("page_id") % 4, 1).alias("dirty"), S.without_sentinel(F.col("page_id"), 3).alias("id"))


@query("file_id", "SELECT p_partkey, p_name || '_' || p_size AS id FROM part")
def file_id(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.file_id(F.col("p_name"), F.col("p_size")).alias("id"))


# Template joins


@query("template_join", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 2 = 0")
def template_join(spark, sf):
    instances = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" {K-"), F.col("l_suppkey").cast("string"), F.lit("}")).alias("guid"))
    known = table(spark, sf, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "k-").otherwise("other-"), F.col("s_suppkey").cast("string")).alias("guid"), "s_name")
    return templates.with_offline_template(instances, known).select("l_orderkey", "l_linenumber", "s_name")


@query("event_key_join", """WITH last AS (SELECT l_suppkey, l_partkey % 10 AS event_id, max(struct_pack(o := l_orderkey, n := l_linenumber)) AS best FROM lineitem GROUP BY ALL)
SELECT event_seq, best.o AS template FROM (SELECT event_id AS event_seq, user_id % 20 + 1 AS provider, event_id % 10 AS e FROM events) LEFT JOIN last ON l_suppkey = provider AND last.event_id = e""")
def event_key_join(spark, sf):
    index = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("provider_guid"), (F.col("l_partkey") % 10).alias("event_id"), F.lit(0).alias("version"), F.struct("l_orderkey", "l_linenumber").alias("insert_seq"), F.col("l_orderkey").alias("template"))
    events = table(spark, sf, "events").select(F.col("event_id").alias("event_seq"), (F.col("user_id") % 20 + 1).alias("provider_guid"), (F.col("event_id") % 10).alias("event_id"), F.lit(0).alias("version"))
    return templates.resolve_template(events, index).select("event_seq", "template")


@query("first_source_wins", "SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def first_source_wins(spark, sf):
    return templates.first_by(table(spark, sf, "part"), ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query("event_templates_index", "SELECT p_brand, p_size, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS guids FROM part GROUP BY ALL")
def event_templates_index(spark, sf):
    return templates.event_templates_index(table(spark, sf, "part"), ["p_brand", "p_size"], "p_type").select("p_brand", "p_size", F.array_join("guids", "|").alias("guids"))


@query("manifest_stats", "SELECT count(DISTINCT p_brand) AS providers, count(DISTINCT p_type) AS templates, count(*) AS events FROM part")
def manifest_stats(spark, sf):
    by = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"), F.count("*").alias("events"))
    return by.select("events", F.explode("types").alias("t")).select("t").distinct().agg(F.count("*").alias("templates")).crossJoin(F.broadcast(by.agg(F.count("*").alias("providers"), F.sum("events").alias("events")))).select("providers", "templates", "events")
