"""Queries over log files by way of the chunk index, the stream source and the dump sink."""

from __future__ import annotations

import json
import time
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import normalised_guid
from ..operators import logs as L
from ..operators import tables, templates
from ..operators.catalogue import Catalogue
from ..operators.columns import DEFAULT, Columns, event_data, shown
from ..operators.filters import Filters
from ..session import shared_path
from ..sources import dump, windows, winlog, zones
from ..streaming.ingest import Progress, ingest, stream_chunks
from ..templates import cache, render
from ..templates import manifest as M
from . import manifests
from .catalogue import ORACLE_SQL, K, query
from .decode import PARTS
from .files import _part, written_logs
from .view import logs, sql, table

#: Of each event its file and chunk in a written folder.
PLACED = f"WITH {PARTS}, placed AS (SELECT *, record_id // 2000 AS part, record_id % 2000 // 50 AS chunk FROM parts)"


def _opened(spark, folder, index, filters=Filters(), ids=()):
    """How many chunks a filtered read opens: each gives one row of the view chunks."""
    return zones.scan(zones.candidates(spark, folder, index, filters, ids, extensions="evtx"), view="chunks").count()


@query("chunk_index_scan", f"""{PLACED}, hit AS (SELECT * FROM placed WHERE eid IN (4607, 4650) AND lvl IN (2, 3))
SELECT record_id, part, (SELECT count(*) FROM (SELECT part, chunk FROM placed GROUP BY 1, 2 HAVING bool_or(eid IN (4607, 4650)) AND bool_or(lvl IN (2, 3)))) AS opened,
  (SELECT count(DISTINCT record_id // 50) FROM placed) AS chunks FROM hit""")
def chunk_index_scan(spark, sf):
    """Two clauses over an indexed folder: of all chunks only those with both are opened."""
    folder, index = written_logs(spark, sf), shared_path(spark, "index")
    zones.update(spark, folder, index, extensions="evtx")
    filters = Filters(event_id=(4607, 4650), level=(2, 3))
    opened, chunks = _opened(spark, folder, index, filters), zones.read_index(spark, index).where("records > 0").count()
    rows = zones.read(spark, folder, index, filters, extensions="evtx")
    return rows.select("record_id", _part(), F.lit(opened).cast("long").alias("opened"), F.lit(chunks).cast("long").alias("chunks"))


@query("chunk_index_filters", f"""{PLACED}, hits AS (
  SELECT 'ids' AS asked, * FROM placed WHERE record_id IN (5, 901) OR record_id BETWEEN 120 AND 130
  UNION ALL SELECT 'times', * FROM placed WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'
  UNION ALL SELECT 'provider', * FROM placed WHERE provider = 'Provider-signup' AND channel = 'Security')
SELECT asked, record_id, part FROM hits""")
def chunk_index_filters(spark, sf):
    """Several filters over one folder and one index, each with chunks of its own; half of the
    files are only written once the index exists, and are opened whole."""
    folder, index = written_logs(spark, sf, only="part % 2 = 0"), shared_path(spark, "index")
    zones.update(spark, folder, index, extensions="evtx")
    written_logs(spark, sf, folder=folder, only="part % 2 = 1")
    asked = {"ids": (Filters(), [(5, 5), (901, 901), (120, 130)]), "times": (Filters(time_range=(datetime(2024, 1, 5), datetime(2024, 1, 6, 12))), ()), "provider": (Filters(provider=("Provider-signup",), channel=("Security",)), ())}
    rows = [zones.read(spark, folder, index, f, ids, extensions="evtx", json=True).select(F.lit(name).alias("asked"), "record_id", _part()) for name, (f, ids) in asked.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("facet_states", "SELECT 'channel' AS facet, CASE user_id % 3 WHEN 0 THEN 'Security' WHEN 1 THEN 'System' ELSE 'Application' END AS key, count(*) AS cnt FROM events GROUP BY 2 UNION ALL SELECT 'event_id', CAST(4600 + user_id % 100 AS VARCHAR), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'provider', 'Provider-' || event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'level', CAST(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 0 WHEN 'click' THEN 4 ELSE 5 END AS VARCHAR), count(*) FROM events GROUP BY 2")
def facet_states(spark, sf):
    """Facets of all files from saved counts by chunk, added to as files come; no log is read for them."""
    folder, index = written_logs(spark, sf, only="part % 2 = 0"), shared_path(spark, "index")
    zones.update(spark, folder, index, extensions="evtx")
    written_logs(spark, sf, folder=folder, only="part % 2 = 1")
    zones.update(spark, folder, index, extensions="evtx")
    return zones.facet_counts(spark, folder, index, extensions="evtx")


@query("stream_growth", "SELECT event_id AS record_id, count(*) OVER () AS total, CASE WHEN event_id % 2000 < 1010 THEN 1 ELSE 2 END AS run FROM events")
def stream_growth(spark, sf):
    """Files that grow between two runs of a stream, in the middle of a chunk: each record once."""
    to, state = shared_path(spark, "grown"), shared_path(spark, "progress")
    folder = written_logs(spark, sf, only="event_id % 2000 < 1010")
    first = None
    for run in (1, 2):
        rows = stream_chunks(spark, folder, extensions="evtx", view="record_headers", chunksPerPartition=7, packed=True)
        ingest(rows, f"{to}/rows", state).awaitTermination()
        if run == 1:
            first = [f.replace("file:///", "/") for f in spark.read.parquet(f"{to}/rows").inputFiles()]
            written_logs(spark, sf, folder=folder)
    rows = spark.read.parquet(f"{to}/rows")
    early = F.regexp_replace(F.input_file_name(), "^file:///", "/").isin(first)
    return rows.select("record_id", F.lit(rows.count()).cast("long").alias("total"), F.when(early, 1).otherwise(2).alias("run"))


@query("dump_order", f"""{PLACED} SELECT record_id, part, lag(record_id) OVER (PARTITION BY part ORDER BY record_id) AS before FROM placed""")
def dump_order(spark, sf):
    """A dump of JSON lines whose parts, one after another, are in record order, although nothing
    was sorted. A first try fails in its last task and leaves nothing."""
    folder, to = written_logs(spark, sf), f"{shared_path(spark, 'dump')}/out"
    rows = winlog.read(spark, folder, extensions="evtx", chunksPerPartition=40)
    broken = rows.withColumn("Raw", F.when(F.col("record_id") % 2000 == 30, F.raise_error(F.lit("given up"))).otherwise(F.col("Raw")))
    try:
        dump.write(broken, to, kind="jsonl")
        raise AssertionError("a dump that fails must not end well")
    except Exception as e:
        if "given up" not in str(e):
            raise
    fs, inner = winlog._open(to)
    if fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
        raise AssertionError("a dump that failed has left files")
    dump.write(rows, to, kind="jsonl")
    lines = dump.text(spark, to).select("part", "nth", F.get_json_object("value", "$.Event.System.EventRecordID").cast("long").alias("record_id"))
    before = F.lag("record_id").over(Window.partitionBy("part").orderBy("nth"))
    return lines.select("record_id", F.regexp_extract("part", r"part-(\d+)", 1).cast("long").alias("part"), before.alias("before"))


@query("dump_errors", "SELECT 'bad' AS kind, CAST(NULL AS VARCHAR) AS line, event_id // 2000 AS part, event_id // 50 % 40 AS chunk FROM events WHERE event_id // 50 % 10 = 7 GROUP BY 3, 4 UNION ALL SELECT 'good', 'Record ' || event_id, NULL, NULL FROM events WHERE event_id // 50 % 10 <> 7")
def dump_errors(spark, sf):
    """An XML dump with banners; chunks whose checksum doesn't fit go to the side files."""
    folder, to = written_logs(spark, sf, "checksum"), f"{shared_path(spark, 'dump')}/out"
    rows = winlog.read(spark, folder, extensions="evtx", xml=True, json=False, validateChecksums=True)
    dump.write(rows, to, kind="xml")
    good = dump.text(spark, to).where("value LIKE 'Record %'").select(F.lit("good").alias("kind"), F.col("value").alias("line"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("chunk"))
    none = F.lit(None).cast("string")
    bad = dump.errors(spark, to).select(F.lit("bad").alias("kind"), none.alias("line"), _part(), F.shiftright("record_seq", 32).cast("long").alias("chunk"))
    return bad.union(good)


@query("pages_of_files", "SELECT event_id AS record_id, event_id // 2000 AS part, CASE WHEN event_id < 700 THEN 1 ELSE 2 END AS page FROM events WHERE event_id < 2500")
def pages_of_files(spark, sf):
    """Two neighbouring pages over several files, the second beyond the end of the first file: they meet and miss nothing."""
    rows = winlog.read(spark, written_logs(spark, sf), extensions="evtx", view="record_headers").where("error IS NULL")
    first, second = L.paged(rows, 700), L.paged(rows, 1800, 700, direct=0)
    return first.select("record_id", _part(), F.lit(1).alias("page")).union(second.select("record_id", _part(), F.lit(2).alias("page")))


@query("eventdata_dotted", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_size <> 5 AND p_type IS NOT NULL")
def eventdata_dotted(spark, sf):
    """Event-data filters, include and exclude, on names with dots, brackets and quotes."""
    data = F.map_from_arrays(F.array(F.lit("a.b"), F.lit("c[0]"), F.lit("it's")), F.array(F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_type")))
    rows = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.struct(data.alias("EventData")).alias("Event"))).alias("Raw"))
    filters = Filters(event_data={"a.b": ["Brand#11", "Brand#22", "Brand#33"]}, event_data_exclude={"c[0]": ["5"], "it's": ["none"]})
    return L.matching(rows, filters).select("p_partkey")


@query("decode_files_with_cache", "SELECT event_id AS record_id, event_id // 50 % 10 <> 7 AS own FROM events WHERE event_id % 2000 BETWEEN 340 AND 420")
def decode_files_with_cache(spark, sf):
    """Whole files from Spark's own reader with damaged templates: a template cache repairs them, and ids are picked."""
    from ..encoder import E, Sub, manifest
    from .decode import GUID

    folder = written_logs(spark, sf, "template")
    offline = manifest(GUID, templates=[(GUID, E("Event", [], [E("Fallback", [], [Sub(11)])]), [])])
    at = f"{shared_path(spark, 'cache')}/t.wevtcache"
    fs, inner = winlog._open(at)
    with fs.open_output_stream(inner) as out:
        out.write(cache.write([offline]))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.evtx").load(folder)
    files = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2000 + 1
    ids = ",".join(f"{2000 * k + 340}-{2000 * k + 420}" for k in range(files))
    rows = winlog.decode_files(raw, templateCache=at, recordIds=ids).where("error IS NULL")
    return rows.select("record_id", (F.get_json_object("Raw", "$.Event.Fallback").isNull()).alias("own"))


@query("cache_table_function", f"SELECT DISTINCT p_brand AS source, {manifests._guid_sql('p_brand || p_type')} AS guid, CAST(nth AS INTEGER) AS entry FROM part, (SELECT unnest([0, 1]) AS nth)")
def cache_table_function(spark, sf):
    """Cache files opened in SQL: a lateral join with a table function gives the manifests in them."""
    manifests.blobs(spark, sf, form=cache.twice).createOrReplaceTempView("cache_files")
    spark.udtf.register("wevt_cache_blobs", cache.CacheBlobs)
    found = spark.sql("SELECT path, b.entry, b.blob AS content FROM cache_files, LATERAL wevt_cache_blobs(content) b")
    made = M.manifests(found.select(F.concat_ws("|", "path", "entry").alias("path"), "content"))
    rows = M.table(made, "templates").select("source", F.upper(normalised_guid(F.col("guid"))).alias("guid"))
    parts = F.split("source", r"\|")
    return rows.select(parts[0].alias("source"), "guid", parts[1].cast("int").alias("entry")).distinct()


@query("window_cache", f"""{PLACED} SELECT record_id, part, pass, CASE pass WHEN 1 THEN 2 ELSE 0 END AS decoded FROM placed, (SELECT unnest([1, 2]) AS pass)
WHERE part = 0 AND (chunk = 3 AND record_id % 50 >= 10 AND record_id % 50 < 30 OR chunk = 8)""")
def window_cache(spark, sf):
    """Windows of chunks, read twice: the second time nothing is decoded."""
    folder = written_logs(spark, sf)
    path, cached = f"{folder}/00000000.evtx", windows.WindowCache(spark, shared_path(spark, "windows"))
    out = None
    for turn in (1, 2):
        before = cached.decoded
        rows = cached.window(path, 3, 10, 20).union(cached.window(path, 8))
        rows = rows.select("record_id", _part(), F.lit(turn).alias("pass"), F.lit(cached.decoded - before).alias("decoded"))
        out = rows if out is None else out.union(rows)
    return out


@query("catalogue_commits", "SELECT p_name || '_' || p_size AS file_id, max(p_partkey) AS chunk_count, p_name || '_' || p_size IN (SELECT max(p_name || '_' || p_size) FROM part UNION ALL SELECT min(p_name || '_' || p_size) FROM part) AS pinned, CAST(4 AS BIGINT) AS version FROM part GROUP BY p_name, p_size")
def catalogue_commits(spark, sf):
    """Two writers pin different files at once, after each other's commits or not: no pin is lost, and every commit is a version."""
    from concurrent.futures import ThreadPoolExecutor

    files = table(spark, sf, "part").select(F.concat(F.lit("/d/"), "p_name").alias("path"), F.col("p_size").cast("long").alias("length"), "p_partkey")
    known = Catalogue(spark, f"{shared_path(spark, 'catalogue')}/t")
    known.commit(lambda old: tables.merged_catalogue(old, tables.catalogue_entry(files.groupBy("path", "length").agg(F.max("p_partkey").alias("n")), chunks=F.col("n"))))
    ends = known.read().agg(F.min("file_id"), F.max("file_id")).first()
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(known.pin, ends))
    known.touch(ends[0])
    return known.read().select("file_id", "chunk_count", "pinned", F.lit(known.version()).cast("long").alias("version"))


@query("columns_registry", sql(f"SELECT Level AS level, EventID AS \"eventId\", json_extract_string(Raw, '$.Event.System.Computer') AS computer, {K} AS \"eventData.k\" FROM logs"))
def columns_registry(spark, sf):
    """Columns added (twice, the second changes nothing) and removed."""
    columns = Columns()
    for id in ("time", "provider", "task", "user", "opcode", "keywords", "none"):
        columns = columns.remove(id)
    return shown(logs(spark, sf), columns.add(event_data("k")).add(event_data("k")).add(DEFAULT[0]).specs)


@query("apply_templates", f"""SELECT p_brand AS source, p_partkey % 65536 AS identifier, '<EventData>' || array_to_string(list_transform(range(0, len(string_split(p_type, ' '))), lambda i: '<Data Name="' || string_split(p_type, ' ')[i + 1] || '">' || [CAST(p_size AS VARCHAR), p_name, 'a&amp;b'][i + 1] || '</Data>'), '') || '</EventData>' AS xml
FROM part WHERE p_partkey % 5 <> 0""")
def apply_templates(spark, sf):
    """Events' values filled into the templates that provider, event id and version lead to."""
    to = f"{shared_path(spark, 'manifests')}/t"
    M.manifests(manifests.blobs(spark, sf, versions=True)).write.parquet(to)  # read three times below
    made = spark.read.parquet(to)
    index = M.event_templates(made).where("template_guid IS NOT NULL").select(F.col("provider").alias("provider_guid"), F.col("identifier").alias("event_id"), "version", "template_guid", F.lit(0).alias("insert_seq"))
    bodies = templates.first_by(M.table(made, "templates"), ["guid"], ["source", "offset"]).select(F.col("guid").alias("template_guid"), "body")
    providers = M.providers(made).select("source", F.col("guid").alias("provider_guid")).distinct()
    nth = F.floor(F.col("p_partkey") / manifests.SLICE).cast("long")
    source = F.concat_ws("|", "p_brand", F.floor(nth / manifests.VERSIONS).cast("long"))
    events = table(spark, sf, "part").select(source.alias("source"), (F.col("p_partkey") % manifests.SLICE).alias("event_id"), (nth % manifests.VERSIONS).alias("version"), F.to_json(F.array(F.col("p_size").cast("string"), "p_name", F.lit("a&b"))).alias("given")).join(providers, "source")
    resolved = templates.resolve_template(events, index).where("template_guid IS NOT NULL").join(bodies, "template_guid")
    return resolved.select(F.split("source", r"\|")[0].alias("source"), F.col("event_id").alias("identifier"), "body", "given").mapInArrow(_applied, "source string, identifier long, xml string")


def _applied(batches):
    for b in batches:
        out = [render.with_values(body, render.json_values(json.loads(values)), indent=False) for body, values in zip(b.column("body").to_pylist(), b.column("given").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("source"), b.column("identifier").cast(pa.int64()), pa.array(out, pa.string())], ["source", "identifier", "xml"])


@query("dump_json", f"""{PLACED} SELECT 'Record ' || record_id AS line FROM placed WHERE record_id % 2000 BETWEEN 90 AND 120 UNION ALL SELECT CAST(count(*) AS VARCHAR) || ' records' FROM placed WHERE record_id % 2000 BETWEEN 90 AND 120""")
def dump_json(spark, sf):
    """A JSON dump with banners of some id ranges, the chunks of which alone are opened, and what its summary says."""
    folder, to = written_logs(spark, sf), f"{shared_path(spark, 'dump')}/out"
    files = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2000 + 1
    rows = winlog.read(spark, folder, extensions="evtx", recordIds=",".join(f"{2000 * k + 90}-{2000 * k + 120}" for k in range(files)))
    dump.write(rows, to, kind="json")
    lines = dump.text(spark, to).where("value LIKE 'Record %'").select(F.col("value").alias("line"))
    return lines.union(spark.createDataFrame([(f"{dump.summary(to)['records']} records",)], "line string"))


@query("ingest_progress", "SELECT count(*) AS rows, CAST(1.0 AS DOUBLE) AS done FROM events")
def ingest_progress(spark, sf):
    """What a listener hears of an ingest in several batches: all rows, and the share of files at the end."""
    folder, heard = written_logs(spark, sf), []
    progress = Progress(lambda batch, rows: heard.append(rows))
    spark.streams.addListener(progress)
    try:
        to = f"{shared_path(spark, 'ingested')}/rows"
        ingest(stream_chunks(spark, folder, extensions="evtx", view="record_headers"), to, shared_path(spark, "progress")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if sum(heard):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    files = spark.read.parquet(to).select("file").distinct().count()
    total = zones.listing(spark, folder, extensions="evtx").count()
    return spark.createDataFrame([(sum(heard), tables.progress(files - 1, total))], "rows long, done double")


def _shredded(spark, sf):
    """The logs table with Raw read once, as Parquet."""
    to = f"{shared_path(spark, 'shredded')}/t"
    tables.shredded(logs(spark, sf)).write.parquet(to)
    return spark.read.parquet(to)


@query("shredded_columns", ORACLE_SQL["default_columns"])
def shredded_columns(spark, sf):
    """The viewer's columns from typed fields that were read at ingest; Raw isn't read."""
    return shown(_shredded(spark, sf), DEFAULT)


@query("shredded_filters", sql(f"SELECT record_seq FROM logs WHERE {K} IN ('1', '2', '3') AND json_extract_string(Raw, '$.Event.EventData.UserId') NOT IN ('7')"))
def shredded_filters(spark, sf):
    """Event-data filters over the map that was read at ingest."""
    return L.matching(_shredded(spark, sf), Filters(event_data={"k": ["1", "2", "3"]}, event_data_exclude={"UserId": ["7"]})).select("record_seq")


@query("shredded_values", sql("SELECT record_seq, CAST(json_extract_string(Raw, '$.Event.System.Task') AS INTEGER) AS task, json_extract_string(Raw, '$.Event.System.Computer') AS computer FROM logs"))
def shredded_values(spark, sf):
    """Typed values out of the stored VARIANT."""
    get = lambda path, kind: F.try_variant_get("value", path, kind)
    return _shredded(spark, sf).select("record_seq", get("$.Event.System.Task", "int").alias("task"), get("$.Event.System.Computer", "string").alias("computer"))
