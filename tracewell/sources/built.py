"""Sessions of all readers in one shape, ready for triage: what the source says of each, and its events in order with call signatures and texts.

Every reader gives the events of a session from a start (of the type start) to an end, which is there only if the session finished. Events come in order of time, those of one time in the order of the source. Texts of a session meet by one aggregation; they are clipped
where the reader clips them. Triage uses sessions and events several times, so a reader writes what it has parsed (the events, and a row a session) to the shared folder and reads it back: a source is parsed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import repetition
from tracewell.functions.completeness import abandonment
from tracewell.operators import sessions
from tracewell.plans.scratch import materialise
from tracewell.sources import exports, session_logs
from tracewell.sources.session_logs import signature

#: Characters of a clipped text, of the texts of an export that are searched for signs of abandonment, and of the shortest text in which a loop counts.
CLIP, OUTPUT, LEAST_TEXT = 500, 4000, 40


@dataclass(frozen=True)
class Built:
    """sessions: (session_id, tokens, runtime_ms, clean, aborted, timed_out, ...); events: (session_id, pos, ts_ms, type, tool_sig, text); texts: (session_id, place, text) of the events with a text, in order by place; last_text: whether the last text alone is the session's output (else all, cut)."""

    sessions: DataFrame
    events: DataFrame
    texts: DataFrame
    last_text: bool = False


def clip(text: Column, most: int = CLIP) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))


def _kind() -> Column:
    return F.when(F.col("type") == "start", 0).when(F.col("type") == "end", 2).otherwise(1)


def _numbered(events: DataFrame) -> DataFrame:
    """(session_id, pos, ...) by kind (a start first, an end last), then time, then `at`. Events without a time stand where the source has them in their session's first instant."""
    order = [_kind(), F.col("ts_ms").asc_nulls_first(), "at"]
    return events.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)).cast("long")).select("session_id", "pos", "ts_ms", "type", "tool_sig", "text")


_EVENT = "STRUCT<ts_ms: BIGINT, type: STRING, tool_sig: STRING, text: STRING, at: BIGINT>"


def _event(ts: Column, kind: Column, sig: Column, text: Column, at: Column) -> Column:
    parts = zip(("ts_ms", "type", "tool_sig", "text", "at"), (ts.cast("long"), kind, sig, text, at.cast("long")))
    return F.struct(*(x.alias(n) for n, x in parts))


def _none() -> Column:
    return F.lit(None).cast("string")


def _edges(built: DataFrame, start: Column, end: Column, finished: Column) -> DataFrame:
    """A start for each session that has a first time, and an end for each that finished."""
    both = F.array(F.when(start.isNotNull(), _event(start, F.lit("start"), _none(), _none(), F.lit(-1))), F.when(finished & end.isNotNull(), _event(end, F.lit("end"), _none(), _none(), F.lit(1 << 40))))
    return built.select("session_id", F.explode(F.array_compact(both)).alias("e")).select("session_id", "e.*")


#: What a reader says of each event.
_OWN = ["session_id", "ts_ms", "type", "tool_sig", "text", "at"]


def _built(built: DataFrame, own: DataFrame, start: str | None, finished: Column, last_text: bool = False) -> Built:
    """Sessions (written here, as they are small) with their own events (_OWN, from a table already written); start: the column of a session's first time, if it has a start."""
    built = materialise(built, "sessions")
    first = F.lit(None).cast("long") if start is None else F.col(start)
    own = own.select(*_OWN)
    # texts need their order only, so they are not numbered with all other events
    texts = own.where("text is not null").select("session_id", F.struct(_kind().alias("kind"), "ts_ms", "at").alias("place"), "text")
    return Built(built, _numbered(own.union(_edges(built, first, F.col("last_ms"), finished))), texts, last_text)


def otlp(traces: DataFrame) -> Built:
    """A failed span is an error; a tool's span a call; any other an output, with its name and model as text."""
    tool = F.coalesce("is_tool", F.lit(False))
    kind = F.when(F.col("failed"), "error").when(tool, "tool_call").otherwise("output")
    said = F.when(~F.col("failed") & F.col("model").isNotNull(), F.concat("name", F.lit(" ("), "model", F.lit(")")))
    own = {"ts_ms": F.col("start_ms"), "type": kind, "tool_sig": F.when(~F.col("failed") & tool, signature(F.col("tool"), F.col("arguments"))), "text": said, "at": F.xxhash64("spanId")}
    spans = materialise(exports.otlp_spans(traces).withColumns(own).drop("arguments"), "spans")
    built = exports.span_sessions(spans)
    built = built.withColumns({"runtime_ms": F.col("last_ms") - F.col("first_ms"), "aborted": ((F.col("n_errors") > 0) | (F.col("unfinished") == 1)).cast("int")})
    return _built(built, spans, "first_ms", F.col("unfinished") == 0)


def langsmith(runs: DataFrame) -> Built:
    """A run with an error is one; a tool's or retriever's a call; any other an output, with its clipped outputs as text."""
    failed = F.coalesce(F.length("error") > 0, F.lit(False))
    call = F.col("run_type").isin("tool", "retriever")
    kind = F.when(failed, "error").when(call, "tool_call").when(F.col("run_type").isin("llm", "chain"), "output").otherwise(F.coalesce(F.nullif("run_type", F.lit("")), F.lit("output")))
    text = F.nullif(clip(F.col("outputs")), F.lit(""))
    own = {"session_id": F.coalesce("trace_id", "id"), "ts_ms": F.unix_millis(F.try_to_timestamp("start_time")), "type": kind, "tool_sig": F.when(~failed & call, signature(F.col("name"), F.col("inputs"))), "text": F.when(~failed, text), "at": F.xxhash64("id")}
    runs = materialise(runs.where("id is not null").withColumns(own).drop("inputs", "outputs"), "runs")
    built = exports.langsmith_sessions(runs)
    built = built.withColumns({"runtime_ms": F.col("last_ms") - F.col("first_ms"), "aborted": ((F.col("n_errors") > 0) | (F.col("unfinished") == 1) | (F.col("timed_out") == 1)).cast("int")})
    return _built(built, runs, "first_ms", F.col("unfinished") == 0)


def export(records: DataFrame) -> Built:
    """Events of an event export; texts are the output, or the tool's name, model or type, and a call's reasoning after it."""
    built = session_logs.export_sessions(records)
    e = records.where("session.session_id is not null").select(F.col("session.session_id").alias("session_id"), F.posexplode("events").alias("i", "e"))
    failed = F.coalesce(F.col("e.event_type") == "error", F.lit(False))
    kind = F.when(F.col("e.event_type").isin("llm_call", "decision"), "output").otherwise(F.coalesce(F.nullif("e.event_type", F.lit("")), F.lit("output")))
    text = F.nullif(clip(F.coalesce("e.output_data", "e.tool_call.tool_name", "e.model", "e.event_type")), F.lit(""))
    reasoned = F.when(F.length("e.tool_call.reasoning") > 0, F.concat(F.lit("reasoning: "), clip(F.col("e.tool_call.reasoning"))))
    sig = F.when((F.col("e.event_type") == "tool_call") & F.col("e.tool_call").isNotNull(), signature(F.col("e.tool_call.tool_name"), F.col("e.tool_call.tool_input")))
    own = e.select("session_id", session_logs._millis(F.col("e.timestamp")).alias("ts_ms"), kind.alias("type"), sig.alias("tool_sig"), F.when(~failed, F.nullif(F.concat_ws("\n", text, reasoned), F.lit(""))).alias("text"), F.col("i").cast("long").alias("at"))
    ended = F.col("last_ms").isNotNull()
    built = built.withColumn("aborted", ((F.col("status").isin("error", "active")) | (F.col("n_errors") > 0) | ~ended).cast("int"))
    return _built(built, materialise(own, "export-events"), "first_ms", ended)


def logs(lines: DataFrame, trajectories: DataFrame) -> Built:
    """Messages of session logs: what the user and the assistant say is output, a message with calls a call (its other calls count as calls only), a result a result; custom records of errors are errors. A session that timed out counts the timeout as an issue."""
    built = session_logs.log_sessions(lines, trajectories)
    m, told = F.col("message"), F.coalesce("data", F.lit(""))
    error = (F.col("type") == "custom") & (F.coalesce("customType", F.lit("")).rlike(session_logs.ERROR) | told.rlike(session_logs.TIMEOUT))
    blocks = F.coalesce(F.from_json(m["content"], f"ARRAY<{session_logs._BLOCK}>"), F.array().cast(f"ARRAY<{session_logs._BLOCK}>"))
    calls = F.filter(blocks, lambda b: b["type"] == "toolCall")
    says = F.when(F.size(blocks) > 0, F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.when(~F.startswith(F.ltrim(m["content"]), F.lit("[")), m["content"]))
    assistant = m["role"] == "assistant"
    kind = F.when(error, "error").when(m["role"] == "toolResult", "tool_result").when(assistant & (F.size(calls) > 0), "tool_call").otherwise("output")
    none = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments")))
    each = F.when(assistant & (F.size(calls) > 0), F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))).otherwise(none)
    rows = lines.where((F.col("type") == "message") | error).select("session_id", session_logs._millis(F.col("timestamp")).alias("ts_ms"), kind.alias("kind"), F.when(assistant, F.nullif(F.trim(says), F.lit(""))).alias("said"), F.posexplode(each).alias("i", "c"))
    first = F.col("i") == 0
    own = rows.select("session_id", "ts_ms", F.when(first, F.col("kind")).otherwise(sessions.FURTHER_CALL).alias("type"), F.when(F.col("kind") == "tool_call", signature(F.col("c.name"), F.col("c.arguments"))).alias("tool_sig"), F.when(first, F.col("said")).alias("text"), F.col("i").cast("long").alias("at"))
    built = built.withColumn("runtime_ms", F.col("last_ms") - F.col("first_ms"))
    built = built.withColumn("told_timeout", ((F.col("timed_out") == 1) & (F.col("clean") == 0) & (F.col("runtime_ms") > 1)).cast("int"))
    return _built(built, materialise(own, "log-events"), None, F.col("clean") == 1, last_text=True)


def triage(built: Built, limits: sessions.Limits = sessions.Limits(), stale_only: bool = True) -> DataFrame:
    """Flagged sessions of any reader, with the text channel: the share of repeated text of clean sessions with enough texts, and signs of abandonment in the output of the others."""
    texts = built.texts.groupBy("session_id").agg(F.count("*").alias("n_assistant"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("texts"))
    joined = F.array_join(F.transform("texts", lambda t: t["text"]), "\n")
    output = F.try_element_at("texts", F.lit(-1))["text"] if built.last_text else F.substring(joined, 1, OUTPUT)
    df = built.sessions.join(texts.select("session_id", "n_assistant", joined.alias("all_text"), output.alias("output")), "session_id", "left").fillna(0, ["n_assistant"])
    repeats = (F.col("clean") == 1) & (F.col("n_assistant") >= limits.least_segments) & (F.length(F.trim("all_text")) >= LEAST_TEXT)
    searched = F.when(repeats, F.col("all_text"))
    ratio = F.when(repeats, F.greatest(repetition.loops(searched)["ratio"], repetition.repetition(searched)["score"]))
    signs = abandonment(df.where("clean = 0 and output is not null"), "session_id", "output").groupBy("session_id").agg(
        F.count_if((F.col("kind") == "abandoned") & (F.col("severity") == "warning")).alias("told_abandoned"),
        F.count_if((F.col("kind") == "abandoned") & (F.col("severity") == "error")).alias("told_unbalanced"),
        F.count_if(F.col("kind") == "no_progress").alias("told_repeating"),
    )
    df = df.withColumn("text_ratio", ratio).drop("all_text", "output").join(signs, "session_id", "left")
    return sessions.triage_built(df, built.events, limits, stale_only)
