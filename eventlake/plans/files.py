"""Queries over written files: the data source, templates of cache files, tables and streams.

The log files are written by tasks into the folder that the cluster shares, one for each
2000 events with 50 in a chunk, so that SQL knows which event lies where.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..binxml import values as V
from ..encoder import ChunkWriter, E, Ref, Sub, Template, Tokens, encode, executable, file_bytes, write_records
from ..operators import logs as L
from ..operators import tables, templates
from ..operators.columns import event_data
from ..session import shared_path
from ..sources import winlog
from ..streaming.ingest import ingest, live_counts, stream_files
from ..templates import cache, pe, render
from ..templates import manifest as M
from . import manifests
from .catalogue import query
from .decode import GUID, PARTS, TEMPLATE, _values, spread
from .view import logs, sql, table

IN_FILE, IN_CHUNK = 2000, 50
#: Every tenth chunk, from the eighth on, is the damaged one where a query asks for damage.
DAMAGED = "event_id // 50 % 10 = 7"


def _write(folder: str, damage: str, copies: bool):
    def run(key, frame):
        import pandas as pd

        chunks = [ChunkWriter() for _ in range(IN_FILE // IN_CHUNK)]
        for r in frame.sort_values("event_id").itertuples():
            time = r.ts.to_pydatetime()
            if not chunks[r.event_id % IN_FILE // IN_CHUNK].add(r.event_id, time, TEMPLATE, _values(r.event_id, time, r.user_id, r.event_type, r.props)):
                raise ValueError("a chunk holds fewer events than its share")
        made = []
        for n, c in enumerate(chunks):
            hurt = damage and n % 10 == 7 and c.ids
            data = bytearray(c.finish(**({"events_crc": 1} if hurt and damage == "checksum" else {})) if c.ids else bytes(65536))
            if hurt and damage == "template":  # the definition inlined in the first record gets an unknown token
                data[512 + 28 + 10 + 24 + 4] = 0x77
            made.append(bytes(data))
        data = file_bytes(made)
        fs, inner = pa.fs.FileSystem.from_uri(folder) if ":/" in folder else (pa.fs.LocalFileSystem(), folder)
        fs.create_dir(f"{inner}/old")
        names = [f"{int(key[0]):08d}.evtx", f"{int(key[0]):08d}.txt", f"old/{int(key[0]):08d}.EVTX"]
        first = data if copies else file_bytes(made[:1])
        for name in names:
            with fs.open_output_stream(f"{inner}/{name}") as out:
                out.write(data if name == names[0] else first)
        return pd.DataFrame({"name": names})

    return run


def written_logs(spark: SparkSession, sf_dir: str, damage: str = "", *, folder: str | None = None, only: str = "true", copies: bool = False) -> str:
    """A folder with a log file for each 2000 events, and beside it one under another extension and one below
    that a query has to leave out: with the first chunk, or whole with ``copies``. ``only`` picks events by ``event_id`` and ``part``, the number of their file; files that
    a given folder has already are written anew."""
    folder = folder or shared_path(spark, "logs")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    events.withColumn("part", F.floor(F.col("event_id") / IN_FILE)).where(only).groupBy("part").applyInPandas(_write(folder, damage, copies), "name string").agg(F.count("*")).collect()
    return folder


PLACE = "event_id // 2000 AS part, event_id % 2000 // 50 AS chunk_no"


def _part() -> Column:
    """The number in a file's name."""
    return F.regexp_extract("file", r"(\d+)\.\w+$", 1).cast("long").alias("part")


@query("source_records", f"WITH {PARTS} SELECT record_id, record_id // 2000 AS part, record_id % 2000 // 50 AS chunk_no, CAST(eid AS INTEGER) AS \"EventID\", provider AS \"Provider\" FROM parts")
def source_records(spark, sf):
    """The files of one folder with one extension, read by the data source."""
    rows = winlog.read(spark, written_logs(spark, sf), extensions="evtx", chunksPerPartition=16, packed=True)
    return rows.where("error IS NULL").select("record_id", _part(), F.col("chunk_no").cast("long").alias("chunk_no"), "EventID", "Provider")


@query("source_recursive", "SELECT event_id // 2000 AS part, 2 * count(*) AS cnt, CAST(2 AS BIGINT) AS files FROM events GROUP BY 1")
def source_recursive(spark, sf):
    """Folders below too; extensions without regard to case."""
    rows = winlog.read(spark, written_logs(spark, sf, copies=True), extensions=".EVTX", recursive=True, view="record_headers")
    return rows.groupBy(_part()).agg(F.count("*").alias("cnt"), F.countDistinct("file").alias("files"))


@query("source_by_id", "SELECT event_id AS record_id, event_id // 2000 AS part FROM events WHERE event_id IN (5, 77, 901) OR event_id BETWEEN 120 AND 130")
def source_by_id(spark, sf):
    """Ids that the source is asked for; it skips chunks by their headers. Two filters on one
    relation don't disturb each other."""
    folder = written_logs(spark, sf)
    asked = winlog.read(spark, folder, extensions="evtx", view="record_headers", recordIds="5,77,120-130").where("record_id < 100")
    rows = winlog.read(spark, folder, extensions="evtx", view="record_headers")
    return asked.union(rows.where("record_id IN (901)")).union(rows.where("record_id BETWEEN 120 AND 130")).select("record_id", _part())


@query("source_checksums", f"SELECT 'ok' AS code, count(*) AS cnt FROM events WHERE NOT {DAMAGED} UNION ALL SELECT 'ChecksumMismatch', count(DISTINCT event_id // 50) FROM events WHERE {DAMAGED} HAVING count(*) > 0")
def source_checksums(spark, sf):
    """A chunk whose checksum doesn't fit is one error row if checksums are asked for."""
    rows = winlog.read(spark, written_logs(spark, sf, "checksum"), extensions="evtx", validateChecksums=True)
    return rows.groupBy(F.coalesce("error.code", F.lit("ok")).alias("code")).agg(F.count("*").alias("cnt"))


@query("source_unchecked", "SELECT count(*) AS cnt, count(DISTINCT event_id) AS ids FROM events")
def source_unchecked(spark, sf):
    """Without the option the same chunks are read."""
    rows = winlog.read(spark, written_logs(spark, sf, "checksum"), extensions="evtx", mode="dropmalformed")
    return rows.agg(F.count("*").alias("cnt"), F.countDistinct("record_id").alias("ids"))


@query("source_files", "SELECT DISTINCT event_id // 2000 AS part, CAST(40 AS BIGINT) AS chunk_count, CAST(3 AS BIGINT) AS major FROM events")
def source_files(spark, sf):
    """File headers."""
    rows = winlog.read(spark, written_logs(spark, sf), extensions="evtx", view="files")
    return rows.select(_part(), F.col("chunk_count").cast("long").alias("chunk_count"), F.col("major").cast("long").alias("major"))


@query("source_chunks", f"SELECT part, chunk_no, min(event_id) AS first_record_id, count(*) AS record_count FROM (SELECT event_id, {PLACE} FROM events) GROUP BY 1, 2")
def source_chunks(spark, sf):
    """Chunk headers, a few chunks in a range."""
    rows = winlog.read(spark, written_logs(spark, sf), extensions="evtx", view="chunks", chunksPerPartition=7, packed=True)
    return rows.where("header_ok AND events_ok").select(_part(), F.col("chunk_no").cast("long").alias("chunk_no"), "first_record_id", F.col("record_count").cast("long").alias("record_count"))


@query("source_limit", "SELECT event_id // 2000 AS part, least(count(*), 100) AS cnt, CAST(100 AS BIGINT) AS first FROM events GROUP BY 1")
def source_limit(spark, sf):
    """Each range's scan stops after its hundredth good row (here a range is a file), or so many rows in all."""
    folder = written_logs(spark, sf, "checksum")
    rows = winlog.read(spark, folder, extensions="evtx", view="record_headers", validateChecksums=True, limit=100, chunksPerPartition=40, packed=True)
    first = winlog.first_records(spark, folder, 100, extensions="evtx").count()
    return rows.where("error IS NULL").groupBy(_part()).agg(F.count("*").alias("cnt"), F.lit(first).cast("long").alias("first"))


def _read_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, n, stream in zip(*(batch.column(c).to_pylist() for c in ("file", "record_count", "ipc")), strict=True):
            with pa.ipc.open_stream(stream) as reader:
                one = reader.read_all()
            if one.num_rows != n:
                raise ValueError("a stream doesn't hold its chunk's records")
            yield from one.select(["record_id", "EventID", "Provider"]).append_column("file", pa.array([file] * n, pa.string())).to_batches()


@query("source_arrow", f"WITH {PARTS} SELECT record_id, record_id // 2000 AS part, CAST(eid AS INTEGER) AS \"EventID\", provider AS \"Provider\" FROM parts")
def source_arrow(spark, sf):
    """Records of each chunk as an Arrow IPC stream, read back from the streams."""
    rows = winlog.read(spark, written_logs(spark, sf), extensions="evtx", view="arrow").where("error IS NULL")
    return rows.mapInArrow(_read_streams, "record_id long, EventID int, Provider string, file string").select("record_id", _part(), "EventID", "Provider")


@query("source_binary_files", "SELECT event_id // 2000 AS part, count(*) AS cnt FROM events GROUP BY 1")
def source_binary_files(spark, sf):
    """Spark's own reader of whole files in front of the decoder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.evtx").load(written_logs(spark, sf))
    return winlog.decode_files(raw, view="record_headers").groupBy(_part()).agg(F.count("*").alias("cnt"))


@query("stream_ingest", "SELECT event_id AS record_id, count(*) OVER () AS total FROM events")
def stream_ingest(spark, sf):
    """Files that come into a folder, appended once although the stream runs twice."""
    folder, to, state = written_logs(spark, sf), shared_path(spark, "ingested"), shared_path(spark, "progress")
    for _ in range(2):
        ingest(stream_files(spark, folder, pattern="*.evtx", mode="dropmalformed"), to, state).awaitTermination()
    rows = spark.read.parquet(to)
    return rows.select("record_id", F.lit(rows.count()).cast("long").alias("total"))


@query("stream_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS cnt FROM events GROUP BY 1")
def stream_counts(spark, sf):
    """Counts by hour of a stream of files, with a watermark; one batch, so none is late."""
    name = f"counts_{uuid.uuid4().hex}"
    rows = stream_files(spark, written_logs(spark, sf), pattern="*.evtx", files_per_trigger=1 << 30)
    live_counts(rows).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", shared_path(spark, "counts")).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "cnt")


# Exports and tables


@query("export_json", sql("SELECT Raw AS line FROM logs WHERE Level IN (2, 3)"))
def export_json(spark, sf):
    """JSON lines of all matching records, read back from the part files."""
    from ..operators.filters import Filters

    to = f"{shared_path(spark, 'export')}/out"
    L.export_json(logs(spark, sf), to, Filters(level=(2, 3)))
    return spark.read.text(to).select(F.col("value").alias("line"))


@query("table_lifecycle", "SELECT count(*) AS appended, 2 * count(*) AS twice, count(*) AS of_session, CAST(0 AS BIGINT) AS cleared FROM events")
def table_lifecycle(spark, sf):
    """Create (twice, the second changes nothing), append by session, read a session, clear."""
    name = f"logs_{uuid.uuid4().hex}"
    rows = logs(spark, sf).select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in ("EventID", "Level", "Provider", "Channel", "Raw") else F.lit(None).cast(f.dataType).alias(f.name) for f in tables.LOGS.fields])
    try:
        for _ in range(2):
            tables.create_logs(spark, name)
        tables.append_logs(rows, name, session="a")
        counts = [spark.table(name).count()]
        tables.append_logs(rows, name, session="b")
        counts += [spark.table(name).count(), tables.of_session(spark, name, "b").count()]
        tables.clear_logs(spark, name)
        counts.append(spark.table(name).count())
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.createDataFrame([counts], "appended long, twice long, of_session long, cleared long")


@query("file_catalogue", "SELECT p_name || '_' || p_size AS file_id, max(p_partkey) AS chunk_count, p_size = 1 AS pinned FROM part WHERE p_size <> 2 GROUP BY p_name, p_size")
def file_catalogue(spark, sf):
    """Files by name and size: known ones meet new ones, the latest opening counts, pins stay, some go."""
    part = table(spark, sf, "part").select(F.concat(F.lit("/d/"), "p_name").alias("path"), F.col("p_size").cast("long").alias("length"), "p_partkey")
    entries = tables.catalogue_entry(part, chunks=F.col("p_partkey"))
    entries = entries.withColumn("last_opened", F.timestamp_seconds("chunk_count"))
    known = tables.merged_catalogue(entries.withColumn("pinned", F.col("size") == 1), entries)
    first = known.agg(F.min("file_id")).first()[0]
    return tables.without_file(tables.pinned(known, first, on=bool(known.where(F.col("file_id") == first).first()["pinned"])), "none").where("size <> 2").select("file_id", "chunk_count", "pinned")


@query("map_records", "SELECT event_id AS record_seq, user_id % 100 + 1 AS next_id FROM events WHERE user_id % 3 = 0")
def map_records(spark, sf):
    """A user function over records; None drops one."""
    rows = logs(spark, sf).select("record_seq", "EventID", "Channel")
    return tables.map_records(rows, lambda r: {"record_seq": r["record_seq"], "next_id": r["EventID"] - 4599} if r["Channel"] == "Security" else None, "record_seq long, next_id long")


@query("field_names_quoted", "SELECT p_partkey, p_name AS dotted, p_brand AS bracket, CAST(p_size AS VARCHAR) AS quote FROM part")
def field_names_quoted(spark, sf):
    """Fields of event data whose names hold dots, brackets and quotes."""
    data = F.map_from_arrays(F.array(F.lit("a.b"), F.lit("c[0]"), F.lit("it's")), F.array(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")))
    rows = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.struct(data.alias("EventData")).alias("Event"))).alias("Raw"))
    return rows.select("p_partkey", event_data("a.b").expr().alias("dotted"), event_data("c[0]").expr().alias("bracket"), event_data("it's").expr().alias("quote"))


# Values


KINDS = [("When", V.SYSTIME), ("Who", V.SID), ("Flag", V.BOOL), ("Ansi", V.ANSI), ("Real", V.REAL64), ("Many", V.UINT16 | V.ARRAY), ("Guid", V.GUID), ("Wide", V.HEX64)]


def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = Template(GUID, E("Event", [], [E("EventData", [], [*(E("Data", [("Name", n)], [Sub(i, k)]) for i, (n, k) in enumerate(KINDS)), E("Data", [("Name", "Entity")], ["a", Ref("amp"), "b"])]), E("UserData", [], [Sub(len(KINDS), V.BINXML)])]))
    def filled(writers: list[ChunkWriter]) -> pa.RecordBatch:
        made = [w.finish() for w in writers]
        return pa.RecordBatch.from_arrays([pa.array(["typed"] * len(made)), pa.array(range(len(made)), pa.int32()), pa.array(made, pa.binary())], ["file", "chunk_no", "chunk"])

    def added(w: ChunkWriter, key: int, values: list) -> bool:
        # The fragment's names are inlined where they stand, so its place has to be known: it's the last value.
        coded = [(k, encode(k, x)) for k, x in values]
        at = 512 + len(w.body) + 28
        if t.guid in w.defined:  # a token with the definition's place, a count, descriptors and values
            before = 10 + 4 + 4 * (len(coded) + 1) + sum(len(b) for _, b in coded)
        else:
            before = len(w.instance(at, t, [*coded, (V.BINXML, b"")], dict(w.names), dict(w.defined)))
        inner = Tokens(at + before, {}, template=False).fragment(E("In", [], [f"side {key}"]))
        return w.add(key, 0, t, [*coded, (V.BINXML, inner)])

    for batch in batches:
        writers = [ChunkWriter()]
        for key, user in zip(batch.column("event_id").to_pylist(), batch.column("user_id").to_pylist(), strict=True):
            values = [(V.SYSTIME, (2000 + key % 30, 1 + key % 12, 0, 1 + key % 28, key % 24, key % 60, 7, key % 1000)), (V.SID, f"S-1-5-21-{user}-500"), (V.BOOL, key % 3), (V.ANSI, f"é{user}"), (V.REAL64, user / 4), (V.UINT16 | V.ARRAY, [key % 7, user % 9]), (V.GUID, GUID), (V.HEX64, user)]
            if not added(writers[-1], key, values):
                writers.append(ChunkWriter())
                if not added(writers[-1], key, values):
                    raise ValueError("a record is larger than a chunk")
            if len(writers) > 64:
                yield filled(writers[:-1])
                writers = writers[-1:]
        yield filled([w for w in writers if w.ids])


_AT = "$.Event.EventData."


@query("value_types", f"""SELECT event_id AS record_id, strftime(make_timestamp(2000 + event_id % 30, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, 7.0) + to_milliseconds(event_id % 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS "When",
  'S-1-5-21-' || user_id || '-500' AS "Who", CASE WHEN event_id % 3 <> 0 THEN 'true' ELSE 'false' END AS "Flag", 'é' || user_id AS "Ansi", CAST(user_id / 4 AS VARCHAR) AS "Real", '{GUID}' AS "Guid", '0x' || lower(to_hex(user_id)) AS "Wide",
  'a&b' AS "Entity", 'side ' || event_id AS nested FROM events""")
def value_types(spark, sf):
    """System times, SIDs, booleans, ANSI text, reals, GUIDs, hexadecimal numbers, entities and a nested fragment."""
    rows = spread(table(spark, sf, "events").select("event_id", "user_id")).mapInArrow(_typed, "file string, chunk_no int, chunk binary")
    shown = [n for n, _ in KINDS if n != "Many"] + ["Entity"]
    out = winlog.decode_chunks(rows)
    return out.select("record_id", *[F.get_json_object("Raw", _AT + n).alias(n) for n in shown], F.get_json_object("Raw", "$.Event.UserData.In").alias("nested"))


@query("array_values", "SELECT event_id AS record_id, event_id % 7 AS first, user_id % 9 AS second, 2 AS items FROM events")
def array_values(spark, sf):
    """An array repeats its element, once for each item: the XML's lines have the items in order."""
    rows = spread(table(spark, sf, "events").select("event_id", "user_id")).mapInArrow(_typed, "file string, chunk_no int, chunk binary")
    xml = winlog.decode_chunks(rows, xml=True, json=False)
    found = F.regexp_extract_all("xml", F.lit('<Data Name="Many">([0-9]+)</Data>'), 1)
    return xml.select("record_id", found[0].cast("long").alias("first"), found[1].cast("long").alias("second"), F.size(found).alias("items"))


def _reals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = Template(GUID, E("Event", [], [E("EventData", [], [E("Data", [("Name", "Real")], [Sub(0, V.REAL64)])])]))
    for batch in batches:
        rows = ((key, 0, t, [(V.REAL64, float(f"{user}e{key % 41 - 20}"))]) for key, user in zip(batch.column("event_id").to_pylist(), batch.column("user_id").to_pylist(), strict=True))
        made = write_records(rows)
        yield pa.RecordBatch.from_arrays([pa.array(["reals"] * len(made)), pa.array(range(len(made)), pa.int32()), pa.array(made, pa.binary())], ["file", "chunk_no", "chunk"])


@query("real_values", """WITH d AS (SELECT event_id, rtrim(CAST(user_id AS VARCHAR), '0') AS d, event_id % 41 - 20 + len(CAST(user_id AS VARCHAR)) - len(rtrim(CAST(user_id AS VARCHAR), '0')) AS k FROM events), p AS (SELECT *, len(d) + k AS p FROM d)
SELECT event_id AS record_id, CASE WHEN d = '' THEN '0.0' WHEN k >= 0 AND p <= 16 THEN d || repeat('0', k) || '.0' WHEN p BETWEEN 1 AND 16 THEN d[1:p] || '.' || d[p + 1:]
  WHEN p BETWEEN -4 AND 0 THEN '0.' || repeat('0', -p) || d ELSE d[1] || CASE WHEN len(d) > 1 THEN '.' || d[2:] ELSE '' END || 'e' || (p - 1) END AS real FROM p""")
def real_values(spark, sf):
    """Reals from 1e-20 to 1e24 and more, with the fewest digits that tell them; large and small ones with an exponent."""
    rows = table(spark, sf, "events").select("event_id", "user_id").mapInArrow(_reals, "file string, chunk_no int, chunk binary")
    return winlog.decode_chunks(rows).select("record_id", F.get_json_object("Raw", _AT + "Real").alias("real"))


# Executables and templates of cache files


@query("executable_resources", "SELECT p_brand AS source, '1' AS name, CAST(1033 AS BIGINT) AS language, CAST(1 AS BIGINT) AS providers, count(DISTINCT p_type) AS templates FROM part GROUP BY 1")
def executable_resources(spark, sf):
    """Manifests found in the resources of executables."""
    resources = pe.manifests_of(manifests.blobs(spark, sf, form=executable)).where("error IS NULL")
    stats = M.stats(M.manifests(resources.select("path", "content")), parts=True).select("source", "providers", "templates")
    return resources.select(F.col("path").alias("source"), "name", "language").distinct().join(stats, "source")


def _rendered(names: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, items, values in zip(b.column("body").to_pylist(), b.column("names").to_pylist(), b.column("given").to_pylist(), strict=True):
                out.append(render.with_placeholders(body, items if names else [], indent=False) if values is None else render.with_values(body, render.json_values(json.loads(values)), indent=False))
            yield pa.RecordBatch.from_arrays([b.column("guid"), pa.array(out)], ["guid", "xml"])

    return run


def _templates(spark: SparkSession, sf_dir: str, given: str | None) -> DataFrame:
    found = M.table(M.manifests(manifests.blobs(spark, sf_dir, form=cache.twice)), "templates")
    return templates.first_by(found, ["guid"], ["source", "offset"]).select("guid", "body", F.transform("items", lambda i: i["name"]).alias("names"), F.lit(given).cast("string").alias("given"))


def _template_sql(text: str) -> str:
    guid = manifests._guid_sql("p_brand || p_type")
    return f"SELECT DISTINCT {guid} AS guid, '<EventData>' || array_to_string(list_transform(range(0, len(string_split(p_type, ' '))), lambda i: '<Data Name=\"' || string_split(p_type, ' ')[i + 1] || '\">' || {text} || '</Data>'), '') || '</EventData>' AS xml FROM part"


@query("template_placeholders", _template_sql("'{sub:' || i || ':' || string_split(p_type, ' ')[i + 1] || '}'"))
def template_placeholders(spark, sf):
    """Provider templates with their items' names in the places of the values."""
    return _templates(spark, sf, None).mapInArrow(_rendered(True), "guid string, xml string")


@query("template_values", _template_sql("['7', '&lt;x&gt;', 'true'][i + 1]"))
def template_values(spark, sf):
    """Provider templates filled with JSON values."""
    return _templates(spark, sf, '[7, "<x>", true]').mapInArrow(_rendered(False), "guid string, xml string")


@query("named_substitutions", "SELECT p_partkey, array_to_string(list_transform(range(1, len(string_split(p_name, ' ')) + 1), lambda i: coalesce(string_split(p_type, ' ')[i], '') || '=' || string_split(p_name, ' ')[i]), '|') AS named FROM part")
def named_substitutions(spark, sf):
    """Substitutions with their template's item names by position."""
    part = table(spark, sf, "part")
    names = part.select(F.col("p_type").alias("guid"), F.split("p_type", " ").alias("item_names")).distinct()
    rows = part.select("p_partkey", F.col("p_type").alias("guid"), F.split("p_name", " ").alias("substitutions"))
    named = templates.named_substitutions(rows, names)
    shown = F.transform(F.filter("named", lambda x: x["value"].isNotNull()), lambda x: F.concat(F.coalesce(x["name"], F.lit("")), F.lit("="), x["value"]))
    return named.select("p_partkey", F.array_join(shown, "|").alias("named"))


@query("template_fallback", "SELECT event_id AS record_id, 'user ' || user_id AS who, event_id // 50 % 10 <> 7 AS own FROM events")
def template_fallback(spark, sf):
    """Records whose own template is damaged are read by the cache file's template of the same GUID."""
    from ..encoder import manifest

    folder = shared_path(spark, "fallback")
    offline = manifest(GUID, templates=[(GUID, E("EventData", [], [E("Data", [], [Sub(0, V.STRING)])]), ["Who"])])
    fs, inner = pa.fs.FileSystem.from_uri(folder) if ":/" in folder else (pa.fs.LocalFileSystem(), folder)
    fs.create_dir(inner)
    with fs.open_output_stream(f"{inner}/t.wevtcache") as out:
        out.write(cache.write([offline]))
    t = Template(GUID, E("EventData", [], [E("Own", [], [Sub(0)])]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Whether a record's own template is damaged goes by chunk, so the two kinds have chunks of their own.
            done, open_ = [], {False: ChunkWriter(), True: ChunkWriter()}

            def close(hurt: bool) -> None:
                data = bytearray(open_[hurt].finish())  # noqa: B023
                if hurt:
                    data[512 + 28 + 10 + 24 + 4] = 0x77
                done.append(bytes(data))  # noqa: B023
                open_[hurt] = ChunkWriter()  # noqa: B023

            for key, user in zip(batch.column("event_id").to_pylist(), batch.column("user_id").to_pylist(), strict=True):
                hurt = key // 50 % 10 == 7
                if not open_[hurt].add(key, 0, t, [(V.STRING, f"user {user}")]):
                    close(hurt)
                    open_[hurt].add(key, 0, t, [(V.STRING, f"user {user}")])
            for hurt in (False, True):
                if open_[hurt].ids:
                    close(hurt)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["chunk"])

    rows = table(spark, sf, "events").select("event_id", "user_id").mapInArrow(encode, "chunk binary").select(F.lit("x").alias("file"), F.lit(0).alias("chunk_no"), "chunk")
    out = winlog.decode_chunks(rows, templateCache=f"{folder}/t.wevtcache").where("error IS NULL")
    data = F.from_json(F.get_json_object("Raw", "$.EventData"), T.MapType(T.StringType(), T.StringType()))
    return out.select("record_id", F.element_at(F.map_values(data), 1).alias("who"), F.map_contains_key(data, "Own").alias("own"))
