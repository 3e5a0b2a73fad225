"""Table lifecycle, file catalogue, user functions and scalar functions."""

from datetime import datetime

from pyspark.sql import functions as F

from eventlake.functions import scalars as S
from eventlake.operators import arrays, facets, logs, tables, templates
from eventlake.operators.columns import USER_SID, Columns, event_data
from eventlake.operators.filters import Filters
from eventlake.plans.view import logs as view


def test_table_lifecycle(spark, sf, tmp_path):
    spark.sql("DROP TABLE IF EXISTS logs_t")
    rows = view(spark, sf).withColumn("error", F.lit(None).cast("string"))
    tables.create_logs(spark, "logs_t")
    tables.create_logs(spark, "logs_t")
    tables.append_logs(rows, "logs_t")
    assert spark.table("logs_t").count() == rows.count()
    plan = spark.table("logs_t").where("Channel = 'Security'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(Channel" in plan
    tables.clear_logs(spark, "logs_t")
    assert spark.table("logs_t").count() == 0
    spark.sql("DROP TABLE logs_t")


def test_file_catalogue(spark):
    files = spark.createDataFrame([("/a/x.evtx", 4096 + 3 * 65536), ("/a/y.evtx", 10)], "path string, length long")
    known = tables.pinned(tables.catalogue_entry(files), "x.evtx_200704")
    again = tables.merged_catalogue(known, tables.catalogue_entry(files))
    got = {r["file_id"]: (r["pinned"], r["chunk_count"]) for r in again.collect()}
    assert got == {"x.evtx_200704": (True, 3), "y.evtx_10": (False, 0)}
    assert tables.without_file(again, "y.evtx_10").count() == 1
    data = spark.createDataFrame([(bytes(4096) + b"a" * 65536 + b"b" * 65536,)], "content binary")
    assert tables.chunk_bytes(data, 1).first()["chunk"] == b"b" * 65536
    assert tables.progress(0, 4) == 0.25 and tables.progress(9, 4) == 1.0


def test_user_functions_and_values(spark, sf):
    rows = view(spark, sf).limit(50)
    made = tables.map_records(rows, lambda r: {"n": r["EventID"]} if r["EventID"] % 2 else None, "n int")
    assert made.count() == rows.where("EventID % 2 = 1").count()
    assert tables.json_values(rows).where("value IS NULL").count() == 0
    assert tables.event_data_map(rows).where("event_data['k'] IS NOT NULL").count() == rows.where("get_json_object(Raw, '$.Event.EventData.k') IS NOT NULL").count()


def test_columns_registry(spark):
    c = Columns().add(event_data("k")).add(event_data("k")).remove("task")
    assert [s.id for s in c.specs][-1] == "eventData.k" and c.get("task") is None and len(c.specs) == 9
    raw = '{"Event":{"System":{"Security_attributes":{"UserID":"S-1-5-18"}}}}'
    df = spark.createDataFrame([(raw,)], "Raw string")
    assert df.select(USER_SID.expr().alias("s"), Columns().get("user").expr().alias("u")).first() == ("S-1-5-18", None)


def test_nulls_in_filters_and_facets(spark):
    rows = spark.createDataFrame([(0, None, None, None, None, "no json"), (1, 5, 2, "P", "C", "{}")], "record_seq long, EventID int, Level int, Provider string, Channel string, Raw string")
    assert logs.count_records(rows, Filters(event_data_exclude={"k": ["1"]})).first()["cnt"] == 0
    assert logs.count_records(rows, Filters(column_equals={"level": ["x"]})).first()["cnt"] == 0
    assert {(r["facet"], r["key"]): r["cnt"] for r in facets.facet_counts(rows).collect()}[("provider", "")] == 1
    assert logs.fetch_records(rows).count() == 1
    assert facets.time_facet(rows, F.lit(None).cast("timestamp")).count() == 0


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(S.systemtime_to_timestamp(F.array(*map(F.lit, (2020, 2, 0, 29, 1, 2, 3, 4))))) == datetime(2020, 2, 29, 1, 2, 3, 4000)
    assert pick(S.systemtime_to_timestamp(F.array(*[F.lit(0)] * 8)).cast("string")) == "1601-01-01 00:00:00"
    assert pick(S.systemtime_to_timestamp(F.array(*map(F.lit, (2020, 13, 0, 29, 1, 2, 3, 4))))) is None
    assert pick(S.hex_text(F.lit(-1).cast("long"))) == "0xffffffffffffffff"
    assert pick(S.level_name(F.lit(None).cast("int"))) == "Information" and pick(S.level_name(F.lit(9))) == "9"
    assert pick(S.utf16_text(F.encode(F.lit("ab\0c"), "UTF-16LE"))) == "ab"
    assert pick(S.ansi_text(F.lit(b"a\xe9\x80\0"))) == "aé€"
    assert pick(S.event_time(F.lit("2021-11-19T16:52:33.833733500Z"))) == datetime(2021, 11, 19, 16, 52, 33, 833733)
    assert pick(S.event_time(F.lit("no time"))) is None
    assert pick(S.json_escaped(F.lit('a"\n'))) == 'a\\"\\n'
    assert pick(S.bool_from_int(F.lit(3))) is True


def test_templates_and_arrays(spark):
    instances = spark.createDataFrame([(1, "{ABC}", ["x", "y"]), (2, "none", ["z"])], "id long, guid string, substitutions array<string>")
    names = spark.createDataFrame([("{ABC}", ["A", "B"])], "guid string, item_names array<string>")
    got = {r["id"]: [tuple(x) for x in r["named"]] for r in templates.named_substitutions(instances, names).collect()}
    assert got == {1: [("A", "x"), ("B", "y")], 2: [(None, "z")]}
    assert templates.last_by(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, s int, v string"), ["k"], ["s"]).first()["v"] == "b"
    assert arrays.event_data_fields(spark.createDataFrame([(1, "bad"), (2, '{"a":"1"}')], "id int, j string"), F.col("j")).select("id", "key", "val").collect() == [(2, "a", "1")]


def test_pages_meet_and_miss_nothing(spark):
    seqs = sorted([None] * 3 + [7] * 5 + [(c << 32) + i for c in (0, 1, 900) for i in range(40)] + [-4, (1 << 62) + 1], key=lambda s: (s is not None, s or 0))
    rows = spark.createDataFrame([(s,) for s in seqs], "record_seq long").repartition(3)
    for limit, ranges in ((10, 4), (64, 4096)):
        got = [r[0] for at in range(0, len(seqs) + limit, limit) for r in logs.paged(rows, limit, at, direct=0, ranges=ranges).collect()]
        assert got == seqs
    assert logs.paged(rows.limit(0), 5, 5, direct=0).count() == 0
    assert logs.paged(rows.where("record_seq IS NULL"), 5, 5, direct=0).count() == 0


def test_late_page_sorts_its_range_alone(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "record_seq")
    narrow, offset = logs._narrowed(rows, 100, 90_000, 4096)
    assert offset < 30 and narrow.count() < 200


def test_export_in_place_and_ordered(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS record_seq", "to_json(struct(id)) AS Raw").repartition(4)
    logs.export_json(rows, str(tmp_path / "a"))
    logs.export_json(rows, str(tmp_path / "b"), ordered=True)
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "b").glob("part-*"))]
    assert sum(parts, []) == [f'{{"id":{i}}}' for i in range(1000)]
    for p in (tmp_path / "a").glob("part-*"):
        ids = [int(x[6:-1]) for x in p.read_text().splitlines()]
        assert ids == sorted(ids)
    assert spark.read.text(str(tmp_path / "a")).count() == 1000
