import json

from tracewell.sources import session_logs as S


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_exports(spark, tmp_path):
    call = {"event_type": "tool_call", "timestamp": "2026-01-01T00:00:10Z", "tokens_in": 5, "tokens_out": 7, "duration_ms": 2000, "tool_call": {"tool_name": "grep", "tool_input": {"q": "a  b"}}}
    session = lambda i, **k: {"session_id": i, "started_at": "2026-01-01T00:00:00Z", **k}
    write(
        tmp_path / "x.jsonl",
        [
            {"session": session("done", ended_at="2026-01-01T00:01:00Z", status="completed"), "stats": {"total_tokens": 99}, "events": [call]},
            {"session": session("open", status="active"), "events": [call, call]},
            {"session": session("bad", ended_at="2026-01-01T00:01:00Z", status="completed"), "events": [{"event_type": "error"}]},
            {"session": None},
            "not json",
        ],
    )
    df = spark.read.schema(S.EXPORT).option("mode", "DROPMALFORMED").json(str(tmp_path))
    rows = {r.session_id: r for r in S.export_sessions(df).collect()}
    assert set(rows) == {"done", "open", "bad"}
    assert (rows["done"].tokens, rows["done"].runtime_ms, rows["done"].clean, rows["done"].timed_out) == (99, 60000, 1, 0)
    assert (rows["open"].tokens, rows["open"].runtime_ms, rows["open"].clean, rows["open"].timed_out, rows["open"].n_tool_calls) == (24, 12000, 0, 1, 2)
    assert (rows["bad"].n_errors, rows["bad"].clean, rows["bad"].timed_out) == (1, 0, 0)
    assert {r.tool_sig for r in S.export_calls(df).where("session_id = 'done'").collect()} == {'grep({"q":"a b"})'}
    assert S.export_sessions(df.limit(0)).count() == 0


def test_logs(spark, tmp_path):
    logs, trajectories = tmp_path / "logs", tmp_path / "traj"
    logs.mkdir()
    trajectories.mkdir()
    say = lambda t, role, **k: {"type": "message", "timestamp": t, "message": {"role": role, **k}}
    tool = [{"type": "text", "text": "look"}, {"type": "toolCall", "name": "ls", "arguments": {}}]
    write(logs / "one.jsonl", [{"type": "session"}, say("2026-01-01T00:00:00Z", "user", content="go"), say("2026-01-01T00:00:05Z", "assistant", content=tool, usage={"totalTokens": 50}), say("2026-01-01T00:00:09Z", "assistant", content="done", stopReason="stop", usage={"totalTokens": 70}), "{broken"])
    write(logs / "two.jsonl", [say("2026-01-01T00:00:00Z", "assistant", content="hm", stopReason="stop"), {"type": "custom", "timestamp": "2026-01-01T00:10:00Z", "customType": "note", "data": {"m": "idle timeout"}}])
    write(trajectories / "two.trajectory.jsonl", [{"ts": "2026-01-01T00:00:00Z", "data": {"usage": {"total": 500}}}])
    write(trajectories / "three.trajectory.jsonl", [{"ts": "2026-01-01T00:00:00Z", "data": {"usage": {"total": 5}}}, {"ts": "2026-01-01T00:00:07Z", "data": {"finalStatus": "success"}}])
    write(trajectories / "four.trajectory.jsonl", [{"ts": "2026-01-01T00:00:00Z", "data": {"aborted": True, "finalStatus": "success"}}])
    out = S.log_sessions(S.read_lines(spark, str(logs), S.LOG), S.read_lines(spark, str(trajectories), S.TRAJECTORY))
    rows = {r.session_id: r for r in out.collect()}
    assert (rows["one"].tokens, rows["one"].clean, rows["one"].n_tool_calls, rows["one"].n_events, rows["one"].source) == (70, 1, 1, 3, "log")
    assert rows["one"].last_ms - rows["one"].first_ms == 9000
    assert (rows["two"].tokens, rows["two"].clean, rows["two"].timed_out, rows["two"].n_errors) == (500, 0, 1, 1)
    assert (rows["three"].clean, rows["three"].source, rows["three"].tokens) == (1, "trajectory", 5)
    assert (rows["four"].clean, rows["four"].aborted) == (0, 1)
