"""Exports and logs as files, read and triaged end to end, against what each should give."""

import json

import pytest

from tracewell.operators.sessions import Limits
from tracewell.sources import built, exports, session_logs

MINUTE = 60_000


def iso(minute):
    return f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


def attribute(key, **value):
    return {"key": key, "value": value}


def span(trace, i, minute, end, *attributes, status="STATUS_CODE_OK", name="chat"):
    nanos = lambda m: str(m * MINUTE * 10**6) if m is not None else None
    return {"traceId": trace, "spanId": f"{trace}{i}", "name": name, "startTimeUnixNano": nanos(minute), "endTimeUnixNano": nanos(end), "attributes": list(attributes), "status": {"code": status}, "events": []}


def tool(trace, i, name, arguments=None, **x):
    more = [attribute("gen_ai.tool.call.arguments", stringValue=json.dumps(arguments))] if arguments else []
    return span(trace, i, i, i + 1, attribute("gen_ai.operation.name", stringValue="execute_tool"), attribute("gen_ai.tool.name", stringValue=name), *more, name="execute_tool", **x)


def rows(df):
    return {r.session_id: r for r in df.collect()}


def test_otlp_end_to_end(spark, tmp_path):
    spans = [
        *(tool("thrash", i, "search", {"q": "x"}) for i in range(6)),
        *(tool("bare", i, "edit" if i % 2 else "read") for i in range(8)),
        *(tool("varied", i, "edit", {"file": i}) for i in range(6)),
        span("rich", 0, 0, 5, attribute("gen_ai.usage.input_tokens", intValue="1200000")),
        span("slow", 0, 0, 40),
        span("cut", 0, 0, 1), span("cut", 1, 2, None),
        span("capped", 0, 0, 1, attribute("gen_ai.response.finish_reasons", arrayValue={"values": [{"stringValue": "length"}]}), status="STATUS_CODE_ERROR"),
        span("fine", 0, 0, 2), span("fine", 1, 2, 4),
        *(span("parrot", i, i, i + 1, attribute("gen_ai.response.model", stringValue="some-large-model")) for i in range(6)),
    ]
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}))
    traces = exports.read_json(spark, str(tmp_path / "x.json"), exports.OTLP)
    got = rows(built.triage(built.otlp(traces)))
    assert {k: r.kind for k, r in got.items()} == {"thrash": "loop-without-progress", "rich": "over-cost", "slow": "over-latency", "capped": "timeout", "parrot": "loop-without-progress"}
    assert got["rich"].costly == 1 and got["rich"].projected_usd == pytest.approx(10.8) and got["capped"].issue_kinds == "no_progress"
    every = rows(built.triage(built.otlp(traces), stale_only=False))
    assert every["cut"].kind == "abandoned" and every["cut"].issue_kinds == "no_end" and "fine" not in every and "bare" not in every


def test_all_broken_budgets_are_listed(spark, tmp_path):
    spans = [*(tool("all", i, "run", {"c": 1}) for i in range(5)), span("all", 9, 5, 60, attribute("gen_ai.usage.output_tokens", intValue="2000000"))]
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}))
    got = rows(built.triage(built.otlp(exports.read_json(spark, str(tmp_path / "x.json"), exports.OTLP)), Limits(most_steps=6)))
    assert got["all"].kind == "over-cost" and got["all"].issue_kinds == "over-cost,over-latency,excessive-steps,loop-without-progress"


def test_langsmith_end_to_end(spark, tmp_path):
    def run(id, trace, parent, kind, minute, end, **x):
        return {"id": id, "trace_id": trace, "parent_run_id": parent, "name": id, "run_type": kind, "start_time": iso(minute), "end_time": iso(end) if end is not None else None, "status": "success"} | x

    runs = [run("a", "a", None, "chain", 0, 2, total_tokens=10, outputs={"answer": "done"}), run("b", "b", None, "chain", 0, 9, error="Deadline exceeded", status="error", total_tokens=300_000)]
    runs += [run("c", "c", None, "chain", 0, 8)] + [run(f"c{i}", "c", "c", "tool", i, i + 1, name="grep", inputs={"pattern": "same"}) for i in range(1, 6)]
    runs += [run("d", "d", None, "chain", 0, None), run("d1", "d", "d", "llm", 20, None, total_tokens=1_500_000), run("d2", "d", "d", "llm", 21, None, error="boom")]
    (tmp_path / "r.json").write_text(json.dumps(runs))
    got = rows(built.triage(built.langsmith(exports.read_json(spark, str(tmp_path / "r.json"), exports.LANGSMITH)), stale_only=False))
    assert {k: r.kind for k, r in got.items()} == {"b": "timeout", "c": "loop-without-progress", "d": "abandoned"}
    assert (got["b"].costly, got["d"].tokens, got["d"].costly) == (1, 1_500_000, 1) and got["d"].issue_kinds == "stale_gap,no_end"


def test_event_export_end_to_end(spark, tmp_path):
    def session(id, status, events, end=10, **stats):
        return {"session": {"session_id": id, "agent_name": "x", "started_at": iso(0), "ended_at": iso(end) if end is not None else None, "status": status}, "stats": stats, "events": events}

    event = lambda kind, minute, **x: {"event_type": kind, "timestamp": iso(minute)} | x
    call = lambda minute, name, given: event("tool_call", minute, tool_call={"tool_name": name, "tool_input": given})
    sessions = [
        session("good", "completed", [event("llm_call", 1, output_data="All is done now."), event("decision", 4)]),
        session("loop", "completed", [call(i, "ls", {"path": "/"}) for i in range(5)]),
        session("bad", "error", [event("error", 1), event("error", 2)], total_tokens=5),
        session("open", "active", [event("llm_call", 1, output_data="I will continue with the next step and then"), event("llm_call", 9, output_data="and")], end=None, total_tokens=2_000_000),
        session("says", "completed", [event("llm_call", i, output_data="I have checked the same file once again.") for i in range(6)]),
    ]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, sessions)))
    got = rows(built.triage(built.export(exports.read_json(spark, str(tmp_path / "e.jsonl"), session_logs.EXPORT)), stale_only=False))
    assert {k: r.kind for k, r in got.items()} == {"loop": "loop-without-progress", "bad": "abandoned", "open": "timeout", "says": "loop-without-progress"}
    assert got["bad"].issue_kinds == "stale_gap,no_progress" and "stale_gap" in got["open"].issue_kinds and "no_end" in got["open"].issue_kinds


def test_session_logs_end_to_end(spark, tmp_path):
    def message(minute, role, content, **x):
        return {"type": "message", "timestamp": iso(minute), "message": {"role": role, "content": content} | x}

    says = lambda t: [{"type": "text", "text": t}]
    calls = lambda name, given: [{"type": "toolCall", "name": name, "arguments": given}]
    files = {
        "done.jsonl": [message(0, "user", "Do it"), message(1, "assistant", says("Did it all, see the list."), stopReason="stop", usage={"totalTokens": 50})],
        "idle.jsonl": [message(0, "user", "Do it"), message(1, "assistant", says("Working on it"), usage={"totalTokens": 400_000}), {"type": "custom", "timestamp": iso(30), "customType": "prompt-error", "data": {"error": "idle timeout"}}],
        "loop.jsonl": [message(0, "user", "Do it"), *(message(i, "assistant", calls("test", {"n": 1})) for i in range(1, 6)), message(7, "assistant", says("ok"), stopReason="stop")],
        "killed.jsonl": [message(0, "user", "Do it"), message(9, "assistant", says("I was"), stopReason="aborted")],
        "killed.trajectory.jsonl": [{"ts": iso(0), "data": {}}, {"ts": iso(9), "data": {"externalAbort": True, "usage": {"total": 77}}}],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(map(json.dumps, lines)))
    logs = session_logs.read_lines(spark, [str(tmp_path / n) for n in files if "trajectory" not in n], session_logs.LOG)
    trajectories = session_logs.read_lines(spark, str(tmp_path / "*.trajectory.jsonl"), session_logs.TRAJECTORY)
    got = rows(built.triage(built.logs(logs, trajectories), stale_only=False))
    assert {k: r.kind for k, r in got.items()} == {"idle": "timeout", "loop": "loop-without-progress", "killed": "abandoned"}
    assert got["idle"].issue_kinds.startswith("timeout") and got["killed"].tokens == 77 and "stale_gap" in got["killed"].issue_kinds
