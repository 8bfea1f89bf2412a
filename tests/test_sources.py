"""Readers and the live guard on small inputs of our own."""

import json
import os

import pytest

from tracewell.sources import exports, transcripts
from tracewell.streaming.guard import GuardLimits, guard


def attribute(key, **value):
    return {"key": key, "value": value}


def span(trace, start, end, *attributes, status="STATUS_CODE_OK", events=()):
    return {"traceId": trace, "spanId": "s", "name": "n", "startTimeUnixNano": str(start * 10**9), "endTimeUnixNano": str(end * 10**9) if end else None, "attributes": list(attributes), "status": {"code": status}, "events": list(events)}


@pytest.mark.parametrize("name", ["export.json", "export.jsonl"])
def test_otlp(spark, tmp_path, name):
    spans = [
        span("t1", 1, 2, attribute("gen_ai.conversation.id", stringValue="a"), attribute("gen_ai.usage.input_tokens", intValue="10"), attribute("gen_ai.usage.completion_tokens", intValue="5")),
        span("t1", 2, 4, attribute("session.id", stringValue="a"), attribute("gen_ai.operation.name", stringValue="execute_tool")),
        span("t2", 1, 3, attribute("gen_ai.response.finish_reasons", arrayValue={"values": [{"stringValue": "length"}]})),
        span("t3", 1, None, events=[{"name": "exception", "attributes": []}]),
    ]
    (tmp_path / name).write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}))
    got = {r.session_id: r for r in exports.otlp_sessions(exports.read_json(spark, str(tmp_path / name), exports.OTLP)).collect()}
    assert (got["a"].tokens, got["a"].clean, got["a"].n_tool_calls, got["a"].last_ms - got["a"].first_ms) == (15, 1, 1, 3000)
    assert (got["t2"].timed_out, got["t2"].clean, got["t3"].n_errors, got["t3"].clean) == (1, 1, 1, 0)


def test_langsmith(spark, tmp_path):
    run = lambda id, trace, parent, kind, **x: {"id": id, "trace_id": trace, "parent_run_id": parent, "name": id, "run_type": kind, "start_time": "2026-01-01T00:00:00Z", "end_time": "2026-01-01T00:01:00Z", "status": "success"} | x
    runs = [run("r1", "t1", None, "chain", total_tokens=99), run("c1", "t1", "r1", "llm", total_tokens=7), run("c2", "t1", "r1", "tool"), run("r2", "t2", None, "chain", total_tokens=50, error="Timed out", status="error"), run("r3", "t3", None, "chain", end_time=None)]
    (tmp_path / "runs.json").write_text(json.dumps(runs))
    got = {r.session_id: r for r in exports.langsmith_sessions(exports.read_json(spark, str(tmp_path / "runs.json"), exports.LANGSMITH)).collect()}
    assert (got["t1"].tokens, got["t1"].clean, got["t1"].label) == (7, 1, "r1")
    assert (got["t2"].tokens, got["t2"].timed_out, got["t2"].clean, got["t3"].clean) == (50, 1, 0, 0)


def test_transcripts(spark, tmp_path):
    (tmp_path / "w1").mkdir()
    (tmp_path / "w1" / "2026-01-02-0304.md").write_text("# T\n## Task\nDo it\n## Actions Taken\n- a\n- b\n\n## Outcome\nSuccess\n## Outcome\nlater\n## Duration\n")
    (tmp_path / "w1" / "notes.md").write_text("## Task\nx")
    docs = transcripts.read_transcripts(spark, str(tmp_path))
    got = {r.slug: r.body for r in transcripts.sections(docs).collect()}
    assert got == {"task": "Do it", "actions taken": "- a\n- b", "outcome": "Success", "duration": ""}
    assert {r.slug for r in transcripts.missing_sections(docs).collect()} == {"key outputs", "duration"}


def run_guard(spark, tmp_path, parts, limits):
    schema = "session_id string, ts_ms long, type string, content string, tokens long"
    for i, part in enumerate(parts):  # a session's state lives on from batch to batch
        part = [(s, 1_700_000_000_000 + ts, *x) for s, ts, *x in part]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
        for f in (tmp_path / "in" / str(i)).iterdir():
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)  # files are read in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = guard(stream, limits).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    states = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    rows = spark.table("stops").collect()
    assert len(rows) == len({r.session_id for r in rows})
    return {r.session_id: r.reason for r in rows}, states


def test_guard(spark, tmp_path):
    rows = [("loop", i, "output", "same line", 1) for i in range(6)] + [("fine", i, "output", f"a line of number {i}", i) for i in range(6)] + [("turns", i, "output", ("first thing", "second thing")[i % 2], 1) for i in range(8)]
    rows += [("gap", 0, "output", "a", 1), ("gap", 150_000, "output", "b", 1), ("rich", 0, "output", "a", 10), ("rich", 1, "output", "b", 1000), ("rich", 2, "output", "c", 9999), *(("long", 90_000 * i, "output", f"words {i}", 1) for i in range(4)), ("long", 350_000, "end", None, 1), ("two", 0, "output", "same text", 1), ("two", 1, "output", "same text", 1)]
    got, _ = run_guard(spark, tmp_path, (rows[:3], rows[3:]), GuardLimits(max_tokens=1000, max_ms=300_000, max_gap_ms=100_000))
    assert got == {"loop": "loop", "turns": "loop", "gap": "stall", "rich": "tokens", "long": "timeout"}


def test_guard_lets_sessions_go(spark, tmp_path):
    first = [("quiet", 0, "output", "a", 1), ("ended", 0, "output", "a", 1), ("ended", 5, "end", None, 1), ("stopped", 0, "output", "a", 5000)]
    later = [("stopped", 10, "output", "b", 9000), ("new", 900_000, "output", "c", 1)]
    got, states = run_guard(spark, tmp_path, (first, later, [("new", 990_000, "output", "d", 1)]), GuardLimits(max_tokens=1000, idle_ms=100_000, late_ms=1000))
    assert got == {"stopped": "tokens", "quiet": "abandoned"} and states == 1
