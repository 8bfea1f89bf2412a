"""Canonical views: plain tables seen as run events, documents and conversations of agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed mapping of the event table's types to the types of run events.
EVENT_TYPES = {"view": "output", "click": "tool_call", "error": "error", "signup": "heartbeat", "purchase": "end"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_events(events: DataFrame) -> DataFrame:
    """(session_id, worker, model, pos, ts_ms, type, tokens, tool, tool_sig): a session is a user's week; pos is the order within it."""
    ts = F.col("ts").cast("timestamp_ntz")
    millis = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / 1000)
    week = F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in EVENT_TYPES.items()), F.lit("output"))
    df = events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), week).alias("session_id"),
        F.concat(F.lit("w"), (F.col("user_id") % 10).cast("string")).alias("worker"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
        "event_id",
        millis.cast("long").alias("ts_ms"),
        kind.alias("type"),
        F.floor(F.col("value") * 1000).cast("long").alias("tokens"),
        (F.get_json_object("props", "$.k").cast("long") % 5).alias("tool"),
        F.concat("event_type", F.lit("("), "props", F.lit(")")).alias("tool_sig"),
    )
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id")).cast("long")).drop("event_id")
