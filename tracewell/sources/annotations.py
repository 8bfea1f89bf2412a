"""Annotations of sessions, written back by judges: one insight of a judge for a session, which a later one of the same judge replaces; all others are kept as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.commits import Store

ANNOTATION = "annotation_id STRING, session_id STRING, text STRING, author STRING, annotation_type STRING, created_at STRING, updated_at STRING"
#: Sessions are dealt into so many partitions by a hash.
PARTS = 64
#: Fixed: what judges' annotations begin with and are called.
OPINION, INSIGHT, JUDGE = "[Tier-3 judge - opinion, not evidence]", "insight", "judge/"


def _replaces() -> Column:
    return (F.col("annotation_type") == INSIGHT) & F.col("author").startswith(JUDGE)


def parse_annotations(lines: DataFrame, column: str = "value") -> DataFrame:
    df = lines.select(F.from_json(column, ANNOTATION).alias("r")).select("r.*")
    return df.dropna(subset=["annotation_id", "session_id"])


def store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, ANNOTATION, lambda: F.pmod(F.xxhash64("session_id"), F.lit(PARTS)), ["annotation_id"], ["updated_at"], parse_annotations)


def annotations_of(verdicts: DataFrame, provider: str, at: str) -> DataFrame:
    """ANNOTATION rows of judge verdicts (session_id, verdict, confidence_label, confidence, summary, suggestions array) by a provider. The id follows from session and author, so a second verdict takes the place of the first."""
    author = F.lit(f"{JUDGE}{provider}")
    head = F.format_string("%s verdict=%s confidence=%s (%.2f)", F.lit(OPINION), "verdict", "confidence_label", F.col("confidence").cast("double"))
    tips = F.when(F.size("suggestions") > 0, F.concat(F.lit("suggestions: "), F.array_join("suggestions", "; "))).otherwise(F.lit(""))
    text = F.concat(head, F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\n"), tips)
    name = F.sha2(F.concat_ws("\x00", "session_id", author, F.lit(INSIGHT)), 256)
    return verdicts.select(name.alias("annotation_id"), "session_id", F.regexp_replace(text, r"\s+$", "").alias("text"), author.alias("author"), F.lit(INSIGHT).alias("annotation_type"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))


def unjudged(sessions: DataFrame, annotations: DataFrame, events: DataFrame, newest: int | None = None) -> DataFrame:
    """Sessions with events and without a judge's insight, the newest first (the first `newest` of them). sessions: session_id, started_at and more; events: session_id."""
    open_ones = sessions.join(annotations.where(_replaces()).select("session_id"), "session_id", "left_anti").join(events.select("session_id"), "session_id", "left_semi")
    ordered = open_ones.orderBy(F.col("started_at").desc_nulls_last(), "session_id")
    return ordered if newest is None else ordered.limit(newest)
