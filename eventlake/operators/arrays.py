"""Relational forms of decode operators: array expansion, sibling suffixes, field lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expanded(df: DataFrame, array: Column, *, value: str = "item", position: str = "pos") -> DataFrame:
    """One row for each item, with its position; a row without items goes."""
    return df.select("*", F.posexplode(array).alias(position, value))


def cross_expanded(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """One row for each pair of items: i of the first, then j of the second inside."""
    return df.select("*", F.posexplode(first).alias("i", "a")).select("*", F.posexplode(second).alias("j", "b"))


def suffixed_names(df: DataFrame, parent: list[str], name: str, position: str) -> DataFrame:
    """``key``: the name, with _1, _2, ... for its repeats among siblings."""
    nth = F.row_number().over(Window.partitionBy(*parent, name).orderBy(position)) - 1
    return df.withColumn("key", F.when(nth == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), nth.cast("string"))))


def positional_data(df: DataFrame, text: Column) -> DataFrame:
    """Unnamed data fields: the lines of a text with their positions."""
    return expanded(df, F.split(text, "\n"), value="data", position="pos")


def event_data_fields(df: DataFrame, json: Column) -> DataFrame:
    """(key, val) rows of a JSON object: strings plain, other values as JSON text. Text
    that isn't a JSON object gives no rows."""
    spark = df.sparkSession
    parsed = df.withColumn("v_", F.try_parse_json(json))
    fields = spark.tvf.variant_explode(F.col("v_").outer())
    return parsed.lateralJoin(fields).withColumn("val", F.col("value").cast("string")).drop("v_", "pos", "value")
