"""Results and bounds of the written-file queries on tables larger than the given ones."""

import re
import struct
import tracemalloc
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from eventlake.encoder import ChunkWriter, E, file_bytes, manifest
from eventlake.plans import catalogue, files, manifests, storage  # noqa: F401
from eventlake.plans.decode import GUID, TEMPLATE, _values
from eventlake.sources import winlog
from eventlake.templates import cache
from eventlake.templates import manifest as M

EPOCH = datetime(2024, 1, 1)


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    got = catalogue.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(cursor.fetchall())


@pytest.fixture(scope="module")
def far_parts(sf, tmp_path_factory):
    """Parts whose keys meet modulo 65536, and again modulo 65536 * 256, under one brand."""
    folder = str(tmp_path_factory.mktemp("parts"))
    duckdb.sql(f"""COPY (SELECT s.* REPLACE (s.p_partkey + o AS p_partkey, 'Brand#' || (s.p_partkey % 2) AS p_brand, CASE WHEN o = 0 THEN p_type ELSE 'NEW ' || o || ' TYPE' END AS p_type)
      FROM read_parquet('{sf}/part.parquet') s, (SELECT unnest([0, 65536, 16777216]) AS o) WHERE s.p_partkey < 60) TO '{folder}/part.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", ["apply_templates", "manifest_events", "manifest_event_index", "manifest_channels", "manifest_maps", "manifest_table_stats", "manifest_template_items", "manifest_first_wins", "template_values", "template_placeholders", "executable_resources", "cache_table_function"])
def test_parts_with_equal_identifiers(spark, far_parts, name):
    same_as_sql(spark, far_parts, name, "part")


def test_manifests_are_bounded(spark, far_parts):
    """A manifest has the parts of one range of keys, however many its brand has."""
    made = manifests.blobs(spark, far_parts).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in made} == {"Brand#0": 3, "Brand#1": 3}


def test_ids_by_lookup():
    """Picking ids doesn't grow with the number of ranges, and is what each range alone says."""
    ranges = [(5, 9), (7, 12), (20, 20), (30, 25), (13, 13), ((1 << 63) - 1, (1 << 64) + 5)] + [(100 * k, 100 * k + 3) for k in range(1, 20_000)]
    ids = winlog.Ids(tuple(ranges))
    assert len(ids.lows) == 20_002
    asked = [*range(40), 99, 100, 103, 104, 1_999_903, 1_999_904, (1 << 63) - 1]
    want = [any(low <= i <= high for low, high in ranges) for i in asked]
    assert [ids.meets(i, i) for i in asked] == want
    assert ids.among(pa.array([*asked, None, -3], pa.int64())).to_pylist() == [*want, False, False]
    assert ids.meets(104, 200) and not ids.meets(104, 199) and not winlog.Ids(()).meets(0, 9) and winlog.Ids(()).among(pa.array([1])).to_pylist() == [False]


def test_ranges_share_tasks(tmp_path):
    for k in range(30):
        (tmp_path / f"{k:02d}.evtx").write_bytes(file_bytes([bytes(65536)] * 40))
    tasks = lambda **o: [[(r.path[-7:-5], r.first, r.stop) for r in t.ranges] for t in winlog.WinlogReader(None, [str(tmp_path)], winlog.Options.of(o)).partitions()]
    assert [len(t) for t in tasks()] == [6] * 5
    assert [len(t) for t in tasks(chunksPerPartition="7")] == [1] * 180
    few = tasks(chunksPerPartition="7", packed="true")
    assert len(few) == 5 and [r for t in few for r in t] == [t[0] for t in tasks(chunksPerPartition="7")]
    assert [r for t in tasks(firstRanges="2") for r in t] == [("00", 0, 40), ("01", 0, 40)]


def test_chunks_of_a_file_are_decoded_together(monkeypatch):
    """Also in the views that have a row for each chunk; numbers may repeat where chunks come as a column."""
    calls, decode = [], winlog.BlockDecoder.decode
    monkeypatch.setattr(winlog.BlockDecoder, "decode", lambda self, path, chunks: calls.append(len(chunks)) or decode(self, path, chunks))
    made = []
    for n in range(40):
        w = ChunkWriter()
        for k in range(n % 4):
            w.add(10 * n + k, 0, TEMPLATE, _values(10 * n + k, EPOCH, n, "error", "{}"))
        made.append(bytearray(w.finish()) if n != 6 else bytearray(b"x" * 65536))
    items = [("a", n, bytes(c)) for n, c in enumerate(made)] + [("a", 3, bytes(made[3])), ("b", 0, bytes(made[2]))]
    for view in ("states", "arrow"):
        o = winlog.Options.of({"view": view})
        calls.clear()
        got = [r for b in winlog.decoded(iter(items), o, winlog.VIEWS[view]) for r in b.to_pylist()]
        assert calls == [40, 1, 1]
        alone = [r for i in items for b in winlog.decoded(iter([i]), o, winlog.VIEWS[view]) for r in b.to_pylist()]
        assert got == alone and len(got) == (42 if view == "states" else 43)


def test_first_records_opens_few_ranges(spark, tmp_path, monkeypatch):
    for k in range(30):
        w = ChunkWriter()
        for i in range(10 if k else 0):
            w.add(100 * k + i, 0, TEMPLATE, _values(i, EPOCH, i, "error", "{}"))
        (tmp_path / f"{k:02d}.evtx").write_bytes(file_bytes([w.finish()] if k else [b"x" * 65536]))
    asked, read = [], winlog.read
    monkeypatch.setattr(winlog, "read", lambda *a, **o: asked.append(o["firstRanges"]) or read(*a, **o))
    assert winlog.first_records(spark, str(tmp_path), 25).count() == 25 and asked == [1, 4]
    asked.clear()
    assert winlog.first_records(spark, str(tmp_path), 1000).count() == 290 and asked == [1, 4, 16, 64]


def test_written_logs_are_not_copied(spark, sf):
    """Files that a query has to leave out hold one chunk; the recursive query's are whole."""
    sizes = lambda folder: {x: sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob(f"*.{x}")) for x in ("evtx", "txt", "EVTX")}
    one, whole = sizes(files.written_logs(spark, sf)), sizes(files.written_logs(spark, sf, copies=True))
    assert one["evtx"] == whole["evtx"] == whole["EVTX"] and 0 < one["txt"] == one["EVTX"] < one["evtx"] / 10


def test_chunks_of_a_batch_are_not_held_twice():
    import tracemalloc

    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 200), pa.array(range(200)), pa.array([bytes([k]) * 65536 for k in range(200)])], ["file", "chunk_no", "chunk"])
    tracemalloc.start()
    try:
        for k, (file, number, data) in enumerate(winlog.one_by_one(batch)):
            assert (file, number, data[:1], len(data)) == ("x", k, bytes([k]), 65536)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", ["array_values", "value_types"])
def test_one_file_is_dealt_to_all_cores(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def python_steps(df):
    """The steps of a query's plan that have Python workers of their own."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return re.findall(r"\b(MapInArrow|FlatMapGroupsInArrow|FlatMapGroupsInPandas|BatchEvalPythonUDTF|ArrowEvalPythonUDTF)\b", plan)


def test_template_values_opens_cache_files_in_one_step(spark, sf):
    assert len(python_steps(catalogue.QUERIES["template_values"](spark, sf))) == 3


def test_manifests_are_dealt_to_tasks(spark, sf, monkeypatch):
    """All cores have some, and a task those of one range's parts, however many there are."""
    assert manifests.blobs(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(manifests, "SLICE", 10)
    assert manifests.blobs(spark, sf).rdd.getNumPartitions() == 20


def test_manifests_in_cache_files(spark):
    """Entries before a damaged one are read."""
    one, other = manifest(GUID, channels=[(16, "a")]), manifest(GUID, channels=[(16, "b")])
    files = spark.createDataFrame([("whole", cache.write([one, other])), ("hurt", cache.write([one, other])[:-1]), ("bare", one)], "path string, content binary")
    found = M.manifests(files).persist()
    assert Counter(tuple(r) for r in M.table(found, "channels").select("source", "name").collect()) == Counter([("whole", "a"), ("whole", "b"), ("hurt", "a"), ("bare", "a")])
    assert [r["source"] for r in found.where("error IS NOT NULL").collect()] == ["hurt"]


class Steps:
    """In place of a DataFrame: gives the function that a step would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("step, form", [(M.manifests, bytes), (M.manifests, cache.twice), (cache.blobs, cache.twice)])
def test_files_of_a_batch_are_opened_one_by_one(step, form):
    made = manifest(GUID, channels=[(16, "a")])
    blob = made[:4] + struct.pack("<I", 1 << 20) + made[8:].ljust((1 << 20) - 8, b"\0")
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(30)]), pa.array([form(blob)] * 30, pa.binary())], ["path", "content"])
    run = step(Steps())
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == (30 if form is bytes else 60)
        assert tracemalloc.get_traced_memory()[1] < 10 << 20
    finally:
        tracemalloc.stop()


def test_cache_table_function_has_three_steps(spark, sf):
    """Cache files are made where manifests are."""
    assert len(python_steps(catalogue.QUERIES["cache_table_function"](spark, sf))) == 3


def test_parts_of_a_manifest_are_counted_once(spark):
    """What parts repeat counts once, their events always; providers are told apart."""
    tree = E("EventData", [], [])
    one = manifest(GUID, channels=[(16, "a")], levels=[(1, "x"), (2, "y")], templates=[(GUID, tree, [])], events=[{"identifier": 1}, {"identifier": 2}], value_maps=[[1, 2], [3]])
    other = manifest(GUID, channels=[(16, "a"), (17, "b")], levels=[(2, "y")], templates=[(GUID, tree, []), ("00000000" + GUID[8:], tree, [])], events=[{"identifier": 1}], value_maps=[[1, 2], [4]])
    foreign = manifest("00000000" + GUID[8:], channels=[(16, "a")])
    files = spark.createDataFrame([("s", one), ("s", other), ("s", foreign), ("t", one)], "path string, content binary")
    got = M.stats(M.manifests(files), parts=True).select("source", "providers", "templates", "events", "maps", "channels", "levels", "opcodes", "tasks", "keywords").orderBy("source").collect()
    assert [tuple(r) for r in got] == [("s", 2, 2, 3, 3, 3, 2, 0, 0, 0), ("t", 1, 1, 2, 2, 1, 2, 0, 0, 0)]


@pytest.mark.parametrize("name", ["manifest_channels", "manifest_table_stats", "executable_resources"])
def test_no_manifest_holds_a_whole_brand(spark, far_parts, monkeypatch, name):
    counted, step = [], M.manifests
    monkeypatch.setattr(M, "manifests", lambda files, **o: counted.append(files.count()) or step(files, **o))
    catalogue.QUERIES[name](spark, far_parts)
    assert counted == [6]
