"""The logs table as a view over ``events``, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_seq, EventID, Level, Provider, Channel, Raw and ts of every event."""
    e = table(spark, sf_dir, "events")
    kind, user = F.col("event_type"), F.col("user_id")
    event_id = (F.lit(4600) + user % 100).cast("int")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = F.concat(F.lit('{"Event":{"System":{"EventID":'), event_id.cast("string"), F.lit(',"Task":'), (user % 7).cast("string"), F.lit(',"TimeCreated_attributes":{"SystemTime":"'), time, F.lit('"},"Computer":"HOST-'), (user % 5).cast("string"), F.lit('"},"EventData":'))
    data = F.when(F.col("event_id") % 11 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"UserId":"'), user.cast("string"), F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}")))
    return e.select(
        F.col("event_id").alias("record_seq"),
        event_id.alias("EventID"),
        F.when(kind == "error", 2).when(kind == "purchase", 3).when(kind == "signup", 0).when(kind == "click", 4).otherwise(5).cast("int").alias("Level"),
        F.concat(F.lit("Provider-"), kind).alias("Provider"),
        F.when(user % 3 == 0, "Security").when(user % 3 == 1, "System").otherwise("Application").alias("Channel"),
        F.concat(head, data, F.lit("}}")).alias("Raw"),
        "ts",
    )


LOGS_SQL = """
logs AS (
  SELECT event_id AS record_seq,
    CAST(4600 + user_id % 100 AS INTEGER) AS EventID,
    CAST(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 0 WHEN 'click' THEN 4 ELSE 5 END AS INTEGER) AS Level,
    'Provider-' || event_type AS Provider,
    CASE user_id % 3 WHEN 0 THEN 'Security' WHEN 1 THEN 'System' ELSE 'Application' END AS Channel,
    '{"Event":{"System":{"EventID":' || CAST(4600 + user_id % 100 AS INTEGER) || ',"Task":' || user_id % 7
      || ',"TimeCreated_attributes":{"SystemTime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"},"Computer":"HOST-' || user_id % 5 || '"},"EventData":'
      || CASE WHEN event_id % 11 = 0 THEN 'null' ELSE '{"UserId":"' || user_id || '","k":' || json_extract_string(props, '$.k') || '}' END || '}}' AS Raw,
    ts
  FROM events
)"""


def sql(body: str) -> str:
    """A query over the logs view, in DuckDB's SQL."""
    return f"WITH {LOGS_SQL}{body if body.lstrip().startswith(',') else chr(10) + body}"
