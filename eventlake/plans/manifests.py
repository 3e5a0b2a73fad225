"""Provider manifests: parts become events of their brand's provider, their types its templates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binxml import values as V
from ..encoder import E, Sub, manifest
from ..functions.scalars import normalised_guid
from ..operators import templates
from ..templates import manifest as M
from .catalogue import query
from .view import table


def _guid(text: str) -> str:
    h = hashlib.md5(text.encode()).hexdigest().upper()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _guid_sql(text: str) -> str:
    h = f"upper(md5({text}))"
    return f"({h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32])"


#: An event's identifier has 16 bits: a manifest has parts of one such range of keys, so that no two of its events share one.
SLICE, VERSIONS = 65536, 256


def _build(versions: bool, form: Callable[[bytes], bytes]):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        brand, nth = key[0].as_py(), key[1].as_py()
        parts = sorted(zip(*(rows.column(c).to_pylist() for c in ("p_partkey", "p_type", "p_size")), strict=True))
        version, source = (nth % VERSIONS, f"{brand}|{nth // VERSIONS}") if versions else (1, brand)
        types = sorted({t for _, t, _ in parts})
        made = [(_guid(brand + t), E("EventData", [], [E("Data", [("Name", n)], [Sub(i, V.STRING)]) for i, n in enumerate(t.split())]), t.split()) for t in types]
        events = [{"identifier": k % SLICE, "version": version, "level": size % 6, "task": size, "template": types.index(t) if k % 5 else None} for k, t, size in parts]
        blob = manifest(_guid(source), channels=[(16, brand), (17, "Other")], levels=[(int(n), f"level {n}") for n in sorted({e["level"] for e in events})], templates=made, events=events, value_maps=[[1, 2], [3]])
        return pa.table({"path": [source], "content": [form(blob)]})

    return run


def blobs(spark: SparkSession, sf_dir: str, *, versions: bool = False, form: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """(path, content): manifests of each brand, one for each 65536 part keys, in the ``form`` of a file that holds them.
    With ``versions`` each has a version of its own, and each 256 of them a provider and a path (brand|number).
    A task makes those of some 65536 parts, and all cores have tasks, so what its workers hold doesn't grow with the table."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.floor(F.col("p_partkey") / SLICE).cast("long").alias("nth"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-part.count() // SLICE))
    return part.repartition(tasks, "p_brand", "nth").groupBy("p_brand", "nth").applyInArrow(_build(versions, form), "path string, content binary")


@query("manifest_events", f"SELECT p_brand AS source, {_guid_sql('p_brand')} AS provider, p_partkey % 65536 AS identifier, CAST(p_size % 6 AS BIGINT) AS level, CASE WHEN p_partkey % 5 <> 0 THEN {_guid_sql('p_brand || p_type')} END AS template_guid FROM part")
def manifest_events(spark, sf):
    return M.event_templates(M.manifests(blobs(spark, sf))).select("source", "provider", "identifier", "level", "template_guid")


@query("manifest_table_stats", "SELECT p_brand AS source, CAST(1 AS BIGINT) AS providers, count(DISTINCT p_type) AS templates, count(*) AS events, CAST(2 AS BIGINT) AS maps, CAST(2 AS BIGINT) AS channels, count(DISTINCT p_size % 6) AS levels, CAST(0 AS BIGINT) AS opcodes, CAST(0 AS BIGINT) AS tasks, CAST(0 AS BIGINT) AS keywords FROM part GROUP BY 1")
def manifest_table_stats(spark, sf):
    return M.stats(M.manifests(blobs(spark, sf)), parts=True)


@query("manifest_template_items", f"SELECT DISTINCT {_guid_sql('p_brand || p_type')} AS guid, array_to_string(string_split(p_type, ' '), '|') AS names FROM part")
def manifest_template_items(spark, sf):
    return M.table(M.manifests(blobs(spark, sf)), "templates").select("guid", F.array_join(F.transform("items", lambda i: i["name"]), "|").alias("names")).distinct()


@query("manifest_channels", "SELECT DISTINCT p_brand AS source, u.identifier, CASE u.identifier WHEN 16 THEN p_brand ELSE 'Other' END AS name FROM part, (VALUES (CAST(16 AS BIGINT)), (CAST(17 AS BIGINT))) u(identifier)")
def manifest_channels(spark, sf):
    return M.table(M.manifests(blobs(spark, sf)), "channels").select("source", "identifier", "name").distinct()


@query("manifest_event_index", f"SELECT provider, identifier, task, array_to_string(list_sort(list(DISTINCT g)), '|') AS guids FROM (SELECT {_guid_sql('p_brand')} AS provider, p_partkey % 65536 AS identifier, CAST(p_size AS BIGINT) AS task, p_size % 6 AS level, {_guid_sql('p_brand || p_type')} AS g FROM part WHERE p_partkey % 5 <> 0) GROUP BY provider, identifier, task, level")
def manifest_event_index(spark, sf):
    return M.event_index(M.manifests(blobs(spark, sf))).select("provider", "identifier", "task", F.array_join("template_guids", "|").alias("guids"))


@query("manifest_first_wins", f"SELECT lower({_guid_sql('p_brand || p_type')}) AS guid, min(p_brand) AS source FROM part GROUP BY 1")
def manifest_first_wins(spark, sf):
    known = M.table(M.manifests(blobs(spark, sf)), "templates").select(normalised_guid(F.col("guid")).alias("guid"), "source", "offset")
    return templates.first_by(known, ["guid"], ["source", "offset"]).select("guid", "source")


@query("manifest_maps", "SELECT DISTINCT p_brand AS source, 'VMAP' AS kind, nth AS size, v AS identifier FROM part, (VALUES (CAST(2 AS INTEGER), CAST(1 AS BIGINT)), (2, 2), (1, 3)) AS t(nth, v)")
def manifest_maps(spark, sf):
    """The values of each map, and how many its map has."""
    rows = M.table(M.manifests(blobs(spark, sf)), "maps")
    return rows.select("source", "kind", F.size("entries").alias("size"), F.explode("entries").alias("e")).select("source", "kind", "size", "e.identifier").distinct()
