"""Joins of template instances, events and provider templates.

A corpus has few templates next to its records: the template side is written once in the
shared folder, uncompressed, and broadcast if that took at most ``BROADCAST_BYTES``; beyond, it's
joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalised_guid
from ..session import shared_path

BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Run a side once, and hint a broadcast if its rows take at most ``most`` bytes."""
    path = shared_path(df.sparkSession, "side")
    df.write.mode("overwrite").option("compression", "none").parquet(path)
    side = df.sparkSession.read.schema(df.schema).parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).getContentSummary(at).getLength()
    return F.broadcast(side) if size <= most else side


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: the first source wins. Combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first_")).select(*keys, *[F.col(f"first_.{c}").alias(c) for c in rest]).select(*df.columns)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: the last insert wins. Combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last_")).select(*keys, *[F.col(f"last_.{c}").alias(c) for c in rest])


def with_offline_template(instances: DataFrame, templates: DataFrame, *, instance_guid: str = "guid", template_guid: str = "guid") -> DataFrame:
    """Left join by GUID, however either side writes it."""
    right = templates.withColumn("guid_", normalised_guid(F.col(template_guid))).drop(template_guid)
    return instances.withColumn("guid_", normalised_guid(F.col(instance_guid))).join(small(right), "guid_", "left").drop("guid_")


def resolve_template(events: DataFrame, index: DataFrame) -> DataFrame:
    """(provider_guid, event_id, version) to a template: of repeated keys the last insert wins."""
    keys = ["provider_guid", "event_id", "version"]
    return events.join(small(last_by(index, keys, ["insert_seq"])), keys, "left")


def event_templates_index(events: DataFrame, keys: Sequence[str], guid: str) -> DataFrame:
    """Distinct template GUIDs of each event key, in order, as an array ``guids``."""
    return events.groupBy(*keys).agg(F.array_sort(F.collect_set(guid)).alias("guids"))


def named_substitutions(instances: DataFrame, names: DataFrame) -> DataFrame:
    """Substitutions (array) with the template's item names (array) by position."""
    met = instances.join(small(names), "guid", "left")
    return met.withColumn("named", F.zip_with("substitutions", F.coalesce("item_names", F.array().cast("array<string>")), lambda v, n: F.struct(n.alias("name"), v.alias("value"))))
