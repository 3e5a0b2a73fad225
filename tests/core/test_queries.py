"""Every catalogue query against its SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from eventlake.plans import catalogue, decode, files, manifests, storage  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    cursor = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in at) for r in cursor.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf):
    from eventlake.plans.view import table

    plan = table(spark, sf, "events").where("event_id = 5").select("event_id", "ts")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,5)]" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


@pytest.mark.parametrize("name, hours, step", [("time_facet_minute_all", 2, 60), ("time_facet_hour_all", 48, 3600)])
def test_scaled_time_facets_count_every_event(spark, sf, name, hours, step):
    from datetime import datetime

    rows = catalogue.QUERIES[name](spark, sf).collect()
    assert sum(r["cnt"] for r in rows) == spark.read.parquet(f"{sf}/events.parquet").count()
    at = [int((datetime.fromisoformat(r["v"]) - datetime(2000, 1, 1)).total_seconds()) for r in rows]
    assert at[-1] - at[0] <= hours * 3600 and min(b - a for a, b in zip(at, at[1:], strict=False)) == step


def test_template_join_knows_every_supplier(spark, sf, monkeypatch):
    from eventlake.operators import templates

    known, join = [], templates.with_offline_template
    monkeypatch.setattr(templates, "with_offline_template", lambda instances, found: known.append(found.count()) or join(instances, found))
    out = catalogue.QUERIES["template_join"](spark, sf)
    assert known == [spark.read.parquet(f"{sf}/supplier.parquet").count()]
    assert 0 < out.where("s_name IS NULL").count() < out.count()
