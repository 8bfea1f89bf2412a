"""Queries over stores that they write, change and read back, beside the SQL of what must be in them then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import fleet, sessions
from tracewell.operators.sessions import WEEKLY
from tracewell.plans.scratch import scratch_dir
from tracewell.plans.views import run_events, table
from tracewell.sources import annotations, fleet_database, score_store

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed: when the examples' annotations are made.
AT = "2026-01-01T00:00:00.000Z"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_events(table(spark, sf_dir, "events"))


def score_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional scores of zero for all checks, then the real ones of those that did not pass, read back."""
    named = fleet.check_scores(_events(spark, sf_dir), WEEKLY).select("worker", F.col("run_id").alias("runId"), "check", "score", "status", F.lit(None).cast("string").alias("startedAt"), F.col("started_ms").alias("startedAtMs"), F.lit(None).cast("string").alias("detail"))
    at = score_store.store(spark, scratch_dir(spark, "scores"))
    at.write(named.withColumn("score", F.lit(0.0)))
    at.write(named.where("status <> 'pass'"))
    return at.read().select("worker", F.col("runId").alias("run_id"), "check", "score", "status")


def _judged_sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, events, and the annotations after a judge failed those with errors, and then passed those of them that ended."""
    events = _events(spark, sf_dir)
    df = sessions.sessions(events)
    verdict = lambda rows, name, sure, label: annotations.annotations_of(rows.select("session_id", F.lit(name).alias("verdict"), F.lit(label).alias("confidence_label"), F.lit(sure).alias("confidence"), F.concat_ws(" ", F.col("n_errors").cast("string"), F.lit("errors")).alias("summary"), F.when(F.col("has_end") == 1, F.array(F.lit("retry"), F.lit("rest"))).otherwise(F.array().cast("array<string>")).alias("suggestions")), "rules", AT)
    at = annotations.store(spark, scratch_dir(spark, "annotations"))
    at.write(verdict(df.where("n_errors > 0"), "fail", 0.815, "high"))
    at.write(verdict(df.where("n_errors > 0 and has_end = 1"), "pass", 0.5, "medium"))
    return df, events, at.read()


def annotations_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged_sessions(spark, sf_dir)[2].select("session_id", "text", "author", "annotation_type")


def unjudged_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, events, done = _judged_sessions(spark, sf_dir)
    return annotations.unjudged(df.withColumn("started_at", F.col("first_ms")), done, events, 25).select("session_id", "first_ms")


def fleet_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, events and a judge's annotations in databases of their own, read by key ranges: the newest 40 sessions with errors that no judge has seen, with the numbers and tokens of their events."""
    events, path = _events(spark, sf_dir), scratch_dir(spark, "fleet")
    df = sessions.sessions(events).select("session_id", "worker", "first_ms", "n_errors")
    fleet_database.write_table(df, f"{path}/sessions", "sessions")
    fleet_database.write_table(events.select("session_id", "ts_ms", "type", "tokens"), f"{path}/events", "events")
    fleet_database.write_table(df.where("n_errors % 2 = 0").select("session_id", F.lit("judge/rules").alias("author"), F.lit("insight").alias("annotation_type")), f"{path}/annotations", "annotations")
    read = lambda name, columns, *where: fleet_database.read_table(spark, f"{path}/{name}", name, columns, where, 20_000)
    failed = read("sessions", "session_id string, first_ms long", ("n_errors", ">", 0)).withColumn("started_at", F.col("first_ms"))
    newest = annotations.unjudged(failed, read("annotations", "session_id string, author string, annotation_type string"), read("events", "session_id string"), 40)
    own = read("events", "session_id string, type string, tokens long").join(newest, "session_id", "left_semi")
    return own.groupBy("session_id", "type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def registry(run_events_sql: str) -> dict[str, tuple[Query, str | None]]:
    return {
        "score_store_upsert": (score_store_upsert, run_events_sql + "SELECT worker, run_id, \"check\", CASE WHEN status <> 'pass' THEN score ELSE 0.0 END AS score, status FROM sc"),
        "annotations_written": (
            annotations_written,
            run_events_sql + "SELECT session_id, '[Tier-3 judge - opinion, not evidence] verdict=' || CASE WHEN has_end = 1 THEN 'pass confidence=medium (0.50)' ELSE 'fail confidence=high (0.82)' END || chr(10) || n_errors || ' errors' || CASE WHEN has_end = 1 THEN chr(10) || 'suggestions: retry; rest' ELSE '' END AS text, 'judge/rules' AS author, 'insight' AS annotation_type FROM s WHERE n_errors > 0",
        ),
        "fleet_backlog": (
            fleet_backlog,
            run_events_sql + ", newest AS (SELECT session_id FROM s WHERE n_errors > 0 AND n_errors % 2 = 1 ORDER BY first_ms DESC, session_id LIMIT 40) SELECT session_id, type, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM re WHERE session_id IN (SELECT session_id FROM newest) GROUP BY session_id, type",
        ),
        "unjudged_newest": (unjudged_newest, run_events_sql + "SELECT session_id, first_ms FROM s WHERE n_errors = 0 ORDER BY first_ms DESC, session_id LIMIT 25"),
    }
