"""Readers of session exports with events inside, and of session logs with or without a trajectory beside them.

Both give one row a session. Events inside an export are summed within its row; lines of a log meet by an aggregation on
their file's session, in order of their place in the file only where the last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CALL = "STRUCT<tool_name: STRING, tool_input: STRING, reasoning: STRING>"
_EVENT = f"STRUCT<event_type: STRING, timestamp: STRING, tokens_in: LONG, tokens_out: LONG, duration_ms: DOUBLE, model: STRING, output_data: STRING, tool_call: {_CALL}>"
EXPORT = f"session STRUCT<session_id: STRING, agent_name: STRING, started_at: STRING, ended_at: STRING, status: STRING>, stats STRUCT<total_tokens: LONG, total_tokens_in: LONG, total_tokens_out: LONG, session_duration_ms: DOUBLE, error_count: LONG>, events ARRAY<{_EVENT}>"
_BLOCK = "STRUCT<type: STRING, text: STRING, name: STRING, arguments: STRING>"
LOG = "type STRING, timestamp STRING, customType STRING, data STRING, message STRUCT<role: STRING, stopReason: STRING, usage: STRUCT<totalTokens: LONG>, content: STRING>"
TRAJECTORY = "ts STRING, data STRUCT<usage: STRUCT<total: LONG>, idleTimedOut: BOOLEAN, aborted: BOOLEAN, timedOut: BOOLEAN, externalAbort: BOOLEAN, finalStatus: STRING>"
#: Words of a timeout and of an error in a log's custom records.
TIMEOUT, ERROR = "(?i)idle timeout|timed out|timeout", "(?i)prompt-error|error"


def _millis(time: Column) -> Column:
    """Of an ISO time, or of a number of milliseconds written as text."""
    return F.coalesce(time.try_cast("long"), F.unix_millis(F.try_to_timestamp(time)))


def _total(events: Column, value) -> Column:
    return F.aggregate(events, F.lit(0).cast("long"), lambda acc, e: acc + F.coalesce(value(e), F.lit(0)))


def export_sessions(exports: DataFrame) -> DataFrame:
    """(session_id, status, first_ms, last_ms, runtime_ms, tokens, n_events, n_errors, n_tool_calls, clean, timed_out) of exports in the EXPORT schema.

    Totals that an export states win over sums of its events. A session is clean if it completed and ended without errors; one
    that is still active or never ended, without errors, counts as timed out. Exports without an id are left out.
    """
    ev = F.coalesce("events", F.array().cast(f"ARRAY<{_EVENT}>"))
    s, st = F.col("session"), F.col("stats")
    status = F.lower(F.coalesce(s["status"], F.lit("")))
    first, last = _millis(s["started_at"]), _millis(s["ended_at"])
    both = F.when(st["total_tokens_in"].isNotNull() | st["total_tokens_out"].isNotNull(), F.coalesce(st["total_tokens_in"], F.lit(0)) + F.coalesce(st["total_tokens_out"], F.lit(0)))
    summed = _total(ev, lambda e: F.coalesce(e["tokens_in"], F.lit(0)) + F.coalesce(e["tokens_out"], F.lit(0)))
    errors = F.coalesce(st["error_count"], F.size(F.filter(ev, lambda e: e["event_type"] == "error")).cast("long"))
    active = F.array_max(F.transform(ev, lambda e: _millis(e["timestamp"]) + F.coalesce(e["duration_ms"], F.lit(0.0)).cast("long")))
    runtime = F.coalesce(st["session_duration_ms"].cast("long"), last - first, F.greatest(F.lit(0), active - first))
    failed, ended = (status == "error") | (errors > 0), last.isNotNull() & (status != "active")
    return exports.where("session.session_id is not null").select(
        s["session_id"].alias("session_id"),
        status.alias("status"),
        first.alias("first_ms"),
        last.alias("last_ms"),
        runtime.alias("runtime_ms"),
        F.coalesce(st["total_tokens"], both, summed).alias("tokens"),
        F.size(ev).cast("long").alias("n_events"),
        errors.alias("n_errors"),
        F.size(F.filter(ev, lambda e: e["event_type"] == "tool_call")).cast("long").alias("n_tool_calls"),
        ((status == "completed") & ~failed & last.isNotNull()).cast("int").alias("clean"),
        (~ended & ~failed).cast("int").alias("timed_out"),
    )


def export_calls(exports: DataFrame) -> DataFrame:
    """(session_id, pos, tool_sig): tool calls in order, as name(input) with white space collapsed and the input cut at 200 characters."""
    e = exports.select(F.col("session.session_id").alias("session_id"), F.posexplode("events").alias("pos", "e")).where("e.event_type = 'tool_call' and e.tool_call is not null")
    return e.select("session_id", "pos", signature(F.col("e.tool_call.tool_name"), F.col("e.tool_call.tool_input")).alias("tool_sig"))


def signature(tool: Column, given: Column) -> Column:
    """name(input) of a call, with white space collapsed and the input, as compact JSON with keys in order, cut at 200 characters."""
    name = F.coalesce(F.nullif(F.trim(tool), F.lit("")), F.lit("tool"))
    canonical = F.coalesce(F.to_json(F.try_parse_json(given)), given, F.lit(""))
    return F.concat(name, F.lit("("), F.substring(F.regexp_replace(canonical, "\\s+", " "), 1, 200), F.lit(")"))


def read_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of line-wise JSON files with `session_id`, from the file's name up to its first dot; lines that do not parse are dropped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), "([^/.]+)[^/]*$", 1).alias("session_id"))


def list_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, snapshot): the sessions of a folder of logs, from the files' names and sizes alone. Snapshots (<id>.checkpoint.<any>.jsonl) are partial copies of their session: one with a file of its own has no snapshot here, of the others the largest
    snapshot (of equals the first by name) stands for its session."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path", F.col("length").alias("size"))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    partial = F.col("name").contains(".checkpoint.")
    own = files.where(~partial).select(F.regexp_replace("name", "(\\.trajectory)?\\.jsonl$", "").alias("session_id")).distinct()
    saved = files.where(partial).withColumn("session_id", F.substring_index("name", ".checkpoint.", 1)).join(own, "session_id", "left_anti")
    best = saved.groupBy("session_id").agg(F.min(F.struct((-F.col("size")).alias("less"), "name", "path")).alias("best"))
    return own.select("session_id", F.lit(None).cast("string").alias("snapshot")).unionAll(best.select("session_id", "best.path"))


def read_logs(spark: SparkSession, folder: str, schema: str = LOG) -> DataFrame:
    """Records of a folder's logs with their session_id: each session's own file, or the snapshot that stands for it; no other file is opened. The paths pass through the driver, as those of any scan do."""
    sessions = list_sessions(spark, folder).select(F.coalesce("snapshot", F.concat(F.lit(f"{folder.rstrip('/')}/"), "session_id", F.lit(".jsonl"))).alias("path"), "snapshot")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"))
    chosen = sessions.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(there, "name")
    paths = [r.file for r in chosen.select("file").collect()]
    return read_lines(spark, paths, schema) if paths else spark.createDataFrame([], f"{schema}, session_id STRING")


def _bool(c: str) -> Column:
    return F.max(F.coalesce(F.col(c), F.lit(False)).cast("int"))


def log_sessions(lines: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(session_id, first_ms, last_ms, tokens, n_events, n_errors, n_tool_calls, aborted, timed_out, clean, source): logs joined with their trajectories, where either may lack.

    A log is clean if the assistant stopped by itself, nothing was aborted and no timeout was seen; a trajectory alone if its
    final status is success and nothing was aborted. Tokens are the largest total that a message or the trajectory tells.
    """
    m = F.col("message")
    time, told = _millis(F.col("timestamp")), F.coalesce("data", F.lit(""))
    idle = (F.col("type") == "custom") & told.rlike(TIMEOUT)
    broke = (F.col("type") == "custom") & (F.coalesce("customType", F.lit("")).rlike(ERROR) | told.rlike(TIMEOUT))
    calls = F.size(F.filter(F.from_json(m["content"], f"ARRAY<{_BLOCK}>"), lambda b: b["type"] == "toolCall"))
    log = lines.groupBy("session_id").agg(
        F.min(time).alias("l_first"),
        F.max(time).alias("l_last"),
        F.max(m["usage"]["totalTokens"]).alias("l_tokens"),
        F.count_if((F.col("type") == "message") | broke).alias("l_events"),
        F.count_if(broke).alias("n_errors"),
        F.sum(F.when((m["role"] == "assistant") & (calls > 0), calls).otherwise(0)).alias("n_tool_calls"),
        F.max(F.coalesce(m["stopReason"] == "aborted", F.lit(False)).cast("int")).alias("l_aborted"),
        F.max(F.coalesce((m["stopReason"] == "stop") & (m["role"] == "assistant"), F.lit(False)).cast("int")).alias("l_stopped"),
        F.max(F.coalesce(idle, F.lit(False)).cast("int")).alias("l_idle"),
    )
    at = _millis(F.col("ts"))
    traj = trajectories.groupBy("session_id").agg(
        F.min(at).alias("t_first"),
        F.max(at).alias("t_last"),
        F.max("data.usage.total").alias("t_tokens"),
        F.count("*").alias("t_events"),
        F.greatest(_bool("data.aborted"), _bool("data.externalAbort"), _bool("data.idleTimedOut"), _bool("data.timedOut")).alias("t_aborted"),
        F.greatest(_bool("data.idleTimedOut"), _bool("data.timedOut")).alias("t_timed"),
        F.max_by("data.finalStatus", F.when(F.col("data.finalStatus").isNotNull(), at)).alias("t_status"),
    )
    df = log.join(traj, "session_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    aborted = (zero("l_aborted") + zero("t_aborted") > 0) | F.coalesce(F.col("t_status") == "error", F.lit(False))
    bare = F.col("l_events").isNotNull()
    clean = ~aborted & F.when(bare, (zero("l_stopped") == 1) & (zero("l_idle") == 0)).otherwise(F.coalesce(F.col("t_status") == "success", F.lit(False)))
    return df.select(
        "session_id",
        F.coalesce("l_first", "t_first").alias("first_ms"),
        F.coalesce("l_last", "t_last").alias("last_ms"),
        F.greatest(zero("l_tokens"), zero("t_tokens")).alias("tokens"),
        F.coalesce("l_events", "t_events").alias("n_events"),
        zero("n_errors").alias("n_errors"),
        zero("n_tool_calls").alias("n_tool_calls"),
        aborted.cast("int").alias("aborted"),
        F.greatest(zero("l_idle"), zero("t_timed")).alias("timed_out"),
        clean.cast("int").alias("clean"),
        F.when(bare, "log").otherwise("trajectory").alias("source"),
    )
