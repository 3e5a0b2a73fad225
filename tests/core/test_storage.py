"""Chunk index, stream source and dump sink."""

import json
from concurrent.futures import ThreadPoolExecutor

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from eventlake.binxml import values as V
from eventlake.encoder import ChunkWriter, E, Sub, Template, file_bytes
from eventlake.operators import catalogue, logs, tables
from eventlake.operators.columns import DEFAULT, shown
from eventlake.operators.filters import Filters
from eventlake.plans.view import logs as view
from eventlake.sources import dump, stream, windows, winlog, zones
from eventlake.streaming.ingest import ingest, stream_chunks

T = Template("0B5C5F1A-30D4-4F1C-9C1E-7A4F5B2D9E10", E("Event", [], [E("System", [], [E("Provider", [("Name", [Sub(0)])]), E("EventID", [], [Sub(1, V.UINT16)]), E("Level", [], [Sub(2, V.UINT8)]), E("Channel", [], ["C"])])]))


def chunk(ids, provider="P", damage=False):
    w = ChunkWriter()
    for i in ids:
        assert w.add(i, 0, T, [(V.STRING, provider), (V.UINT16, i % 7), (V.UINT8, 2 + i % 2)])
    data = bytearray(w.finish())
    if damage:
        data[512 + 28 + 10 + 24 + 4] = 0x77  # the definition in the first record
    return bytes(data)


def put(path, chunks, **more):
    path.write_bytes(file_bytes(chunks, **more))


def test_index_opens_what_may_match_and_whatever_is_new(spark, tmp_path):
    logs_, index = tmp_path / "logs", str(tmp_path / "index")
    logs_.mkdir()
    put(logs_ / "a.evtx", [chunk(range(10 * k, 10 * k + 10), f"P{k}") for k in range(6)])
    put(logs_ / "b.evtx", [chunk(range(60, 70), "P1"), bytes(65536), chunk(range(70, 75), "P9", damage=True)])
    (logs_ / "c.evtx").write_bytes(b"no log")
    folder = str(logs_)
    opened = lambda f=Filters(), ids=(): sorted((r["file"][-6:], r["chunk_no"]) for r in zones.candidates(spark, folder, index, f, ids).collect())
    whole = [("a.evtx", k) for k in range(6)] + [("b.evtx", k) for k in range(3)] + [("c.evtx", 0)]
    assert opened(Filters(provider=("P1",))) == whole  # there is no index yet
    assert zones.update(spark, folder, index) == 3 and zones.update(spark, folder, index) == 0
    assert opened(Filters(provider=("P1",))) == [("a.evtx", 1), ("b.evtx", 0)]
    assert opened(ids=[(9, 10)]) == [("a.evtx", 0), ("a.evtx", 1)]
    assert opened(Filters(provider=("none",))) == [] and opened(Filters(event_id=(6,), level=(9,))) == []
    got = zones.read(spark, folder, index, Filters(provider=("P1",), level=(3,)), [(0, 65)])
    assert sorted(r["record_id"] for r in got.collect()) == [11, 13, 15, 17, 19, 61, 63, 65]
    # A damaged template costs its records; facets count the good ones.
    good = winlog.read(spark, folder).where("error IS NULL").count()
    assert zones.facet_counts(spark, folder, index).where("facet = 'channel'").collect() == [("channel", "C", good)]
    # A changed file is opened whole until the index follows.
    put(logs_ / "b.evtx", [chunk(range(60, 70), "P1"), chunk(range(90, 95), "P1")])
    assert opened(ids=[(0, 5)]) == [("a.evtx", 0), ("b.evtx", 0), ("b.evtx", 1)]
    with pytest.raises(ValueError):
        zones.facet_counts(spark, folder, index)
    assert zones.update(spark, folder, index) == 1 and opened(ids=[(0, 5)]) == [("a.evtx", 0)]


def test_reached_place_of_a_growing_file():
    def at(chunks, **more):
        data = file_bytes(chunks, **more)
        return stream.reached(lambda a, n: data[a : a + n], len(data))

    assert at([chunk(range(5))]) == (0, 5)
    assert at([chunk(range(5)), chunk(range(5, 8)), bytes(65536), bytes(65536)], chunk_count=4) == (1, 3)
    assert at([chunk(range(5)), chunk(range(5, 8)), bytes(65536)], chunk_count=2) == (1, 3)
    assert at([bytes(65536)], chunk_count=1) == (0, 0) and at([], chunk_count=0) == (0, 0)
    assert at([chunk(range(5)), b"\1" * 65536]) == (1, 1)


@pytest.mark.parametrize("step", [1, 2, 100])
@pytest.mark.parametrize("start, end", [((0, 0), (5, 3)), ((2, 4), (5, 3)), ((5, 1), (5, 3)), ((5, 3), (5, 3)), ((0, 0), (0, 2))])
def test_pieces_cover_each_place_once(start, end, step):
    size = 10
    got = []
    for p in stream.pieces("f", start, end, step):
        assert p.stop - p.first <= step
        for n in range(p.first, p.stop):
            got += [(n, k) for k in range(size) if k >= (p.skip if n == p.first else 0) and (p.until is None or n < p.stop - 1 or k < p.until)]
    assert got == [(n, k) for n in range(end[0] + 1) for k in range(size) if start <= (n, k) < end]


def test_stream_gives_each_record_once_over_restarts(spark, tmp_path):
    files, to, state = tmp_path / "logs", str(tmp_path / "to"), str(tmp_path / "state")
    files.mkdir()

    def run():
        ingest(stream_chunks(spark, str(files), chunksPerPartition=2), to, state).awaitTermination()
        return sorted((r["record_id"] if r["record_id"] is not None else -1) for r in spark.read.parquet(to).collect())

    put(files / "a.evtx", [chunk(range(10)), chunk(range(10, 14))])
    assert run() == list(range(14))
    put(files / "a.evtx", [chunk(range(10)), chunk(range(10, 20)), chunk(range(20, 30)), chunk(range(30, 31))])
    put(files / "b.evtx", [chunk(range(100, 103))])
    assert run() == [*range(31), 100, 101, 102]
    assert run() == [*range(31), 100, 101, 102]
    put(files / "b.evtx", [chunk(range(100, 103)), b"\1" * 65536])  # a damaged chunk is one error row
    assert run() == [-1, *range(31), 100, 101, 102]


def test_dump_order_errors_and_modes(spark, tmp_path):
    put(tmp_path / "a.evtx", [chunk(range(10 * k, 10 * k + 10)) for k in range(5)])
    put(tmp_path / "b.evtx", [chunk(range(50, 60)), b"\1" * 65536])
    rows = winlog.read(spark, str(tmp_path), extensions="evtx", chunksPerPartition=2)
    to = str(tmp_path / "out")
    dump.write(rows, to, kind="json")
    text = "".join(pafs.LocalFileSystem().open_input_stream(p).read().decode() for p in dump.parts(to))
    assert [int(x.split()[1]) for x in text.splitlines() if x.startswith("Record ")] == list(range(60))
    assert dump.summary(to)["records"] == 60 and dump.summary(to)["errors"] == 1 and len(dump.parts(to)) == 4
    assert [r["error"]["code"] for r in dump.errors(spark, to).collect()] == ["InvalidChunkMagic"]
    with pytest.raises(Exception, match="isn't empty"):
        dump.write(rows, to, kind="json")
    dump.write(rows.where("record_id < 15"), to, kind="jsonl", overwrite=True)
    assert dump.summary(to)["records"] == 15 and dump.errors(spark, to).count() == 0
    # What has been shuffled isn't in order: nothing becomes visible, unless order isn't asked for.
    other = str(tmp_path / "other")
    mixed = rows.where("error IS NULL").repartition(3, F.xxhash64("record_id"))
    with pytest.raises(Exception, match="record order"):
        dump.write(mixed, other)
    assert not [p for p in (tmp_path / "other").glob("*")]
    dump.write(mixed, other, ordered=False, kind="jsonl")
    assert dump.summary(other)["records"] == 60


def test_pages_over_files_meet(spark):
    rows = [(f, (c << 32) + i) for f in "abc" for c in (0, 3) for i in range(30)] + [(None, 5), ("b2", 7)]
    df = spark.createDataFrame(rows, "file string, record_seq long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for limit in (7, 50, 100):
        got = [tuple(r) for at in range(0, len(rows) + limit, limit) for r in logs.paged(df, limit, at, direct=0, ranges=8).collect()]
        assert got == want


def test_time_filters_use_the_time_column(spark, sf):
    from datetime import datetime

    path = f"{sf}/events.parquet"
    rows = spark.read.parquet(path).select(F.col("ts"), F.lit("{}").alias("Raw"))
    plan = logs.matching(rows, Filters(time_range=(datetime(2024, 1, 5), datetime(2024, 1, 6))))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan


def test_window_cache_keeps_its_budget_and_sees_changes(spark, tmp_path):
    put(tmp_path / "a.evtx", [chunk(range(10 * k, 10 * k + 10)) for k in range(4)])
    path, cached = str(tmp_path / "a.evtx"), windows.WindowCache(spark, str(tmp_path / "cache"))
    ids = lambda *a: [r["record_id"] for r in cached.window(path, *a).collect()]
    assert ids(1, 2, 3) == [12, 13, 14] and ids(1, 2, 3) == [12, 13, 14] and ids(3, 8) == [38, 39]
    assert (cached.decoded, cached.hits) == (2, 1)
    again = windows.WindowCache(spark, str(tmp_path / "cache"))
    assert [r["record_id"] for r in again.window(path, 3, 8).collect()] == [38, 39] and again.decoded == 0
    put(tmp_path / "a.evtx", [chunk(range(100 * k, 100 * k + 10)) for k in range(5)])
    assert ids(1, 2, 3) == [102, 103, 104] and cached.decoded == 3
    one = max(cached.kept.values())
    small = windows.WindowCache(spark, str(tmp_path / "cache"), budget=2 * one)
    assert sum(small.kept.values()) <= 2 * one
    for k in range(5):
        assert small.window(path, k, 0, 1).count() == 1
    assert sum(small.kept.values()) <= 2 * one and len(list((tmp_path / "cache").iterdir())) == len(small.kept)


def test_catalogue_loses_no_commit(spark, tmp_path):
    known = catalogue.Catalogue(spark, str(tmp_path / "t"))
    assert known.read().count() == 0 and known.version() == 0
    files = spark.createDataFrame([(f"/d/f{k}", k) for k in range(6)], "path string, length long")
    known.opened(files)
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(known.pin, [f"f{k}_{k}" for k in range(6)]))
    assert sorted(made) == list(range(2, 8)) and known.read().where("pinned").count() == 6
    assert known.read(1).where("pinned").count() == 0  # older versions stay
    known.delete("f0_0")
    known.opened(files.where("length = 0"))
    assert {(r["file_id"], r["pinned"]) for r in known.read().collect()} == {(f"f{k}_{k}", k > 0) for k in range(6)}
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == known.version()


def test_shredded_tables_leave_raw_unread(spark, sf, tmp_path):
    to = str(tmp_path / "t")
    tables.shredded(view(spark, sf)).write.parquet(to)
    rows = spark.read.parquet(to)
    for df in (shown(rows, DEFAULT), logs.matching(rows, Filters(event_data={"k": ["1"]})).select("record_seq")):
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        scan = plan[plan.index("ReadSchema"):]
        assert "Raw:" not in scan and "from_json" not in plan and "get_json_object(Raw" not in plan
    plan = shown(view(spark, sf), DEFAULT)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 or plan.count("JsonToStructs") == 1 or plan.count("$.Event.System") == 1


@pytest.mark.parametrize("raw", ['{"Event":{"System":{"TimeCreated":{"SystemTime":"2024"},"Task":7,"Computer":"c","Keywords":"0x1","Security":{"UserID":"S-1"}}}}', '{"Event":{"System":{"TimeCreated_attributes":{"SystemTime":"t"},"Task":"x","Opcode":1.5,"Security":null}}}', "no json", '{"Event":null}', None, '{"Event":{"System":{"Task":{"a":[1]},"TimeCreated":"2"}}}'])
def test_one_parse_gives_what_the_paths_give(spark, raw):
    from eventlake.operators.columns import USER_SID

    df = spark.createDataFrame([(raw, 1, 2, "p")], "Raw string, Level int, EventID int, Provider string")
    specs = [*DEFAULT, USER_SID]
    assert shown(df, specs).first() == df.select(*[s.expr().alias(s.id) for s in specs]).first()


def test_commands_that_write_by_tasks(spark, tmp_path, capsys):
    from eventlake import cli
    from eventlake.encoder import executable, manifest
    from eventlake.templates import cache

    put(tmp_path / "a.evtx", [chunk(range(10 * k, 10 * k + 10)) for k in range(3)])
    out = tmp_path / "i.jsonl"
    assert cli.main(["template-instances", str(tmp_path / "a.evtx"), "-f", str(out)]) == 0
    rows = [json.loads(x) for x in out.read_text().splitlines()]
    assert [r["record_id"] for r in rows] == list(range(30))
    assert cli.main(["template-instances", str(tmp_path / "a.evtx"), "--record", "7", "-f", str(out), "--no-confirm-overwrite"]) == 0
    assert [json.loads(x)["record_id"] for x in out.read_text().splitlines()] == [7]
    blobs = [manifest(T.guid, templates=[(T.guid, E("EventData", [], [E("Data", [], [Sub(k)])]), ["n"])]) for k in range(2)]
    for k, b in enumerate(blobs):
        (tmp_path / f"x{k}.exe").write_bytes(executable(b))
    (tmp_path / "x2.exe").write_bytes(b"no executable")
    made = tmp_path / "t.wevtcache"
    assert cli.main(["extract-templates", str(tmp_path), "--extensions", "exe", "-f", str(made)]) == 0
    assert list(cache.read(made.read_bytes())) == blobs
    told = capsys.readouterr().err
    assert "2 manifests" in told and "x2.exe" in told
    with pytest.raises(SystemExit):
        cli.main(["extract-templates", str(tmp_path), "--extensions", "exe", "-f", str(made)])
    assert cli.main(["dump", str(tmp_path / "a.evtx"), "-o", "json", "-f", str(tmp_path / "d.json"), "--events", "28-29"]) == 0
    assert (tmp_path / "d.json").read_text().splitlines()[::2] == ["Record 28", "Record 29"]
