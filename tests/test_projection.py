"""What a judge sees, its budget, and sessions out of files with snapshots."""

import json
import math

import pytest

from tracewell.operators import projection
from tracewell.sources import session_logs

SCHEMA = "id int, output string, task string, artifacts array<struct<name:string,text:string>>"
tokens = lambda s: math.ceil(len(s) / 4)


@pytest.mark.parametrize("cap", [40, 600, 1000, 8000])
def test_caps_hold(spark, cap):
    rows = [(1, "o" * 9000, "t" * 3000, [("a", "x" * 50_000), ("b", "y" * 10), ("c", "z" * 50_000)]), (2, "out", "task", [("a", "x")]), (3, "o" * 100, "t", []), (4, None, None, None), (5, "é" * 5000, "", [("a", ""), ("b", "b" * 900)])]
    got = {r.id: r for r in projection.token_capped(spark.createDataFrame(rows, SCHEMA), cap).collect()}
    for i, output, task, artifacts in rows:
        r = got[i]
        assert r.input_tokens == tokens(r.output) + tokens(r.task) + sum(tokens(a.text) for a in r.artifacts)
        assert r.truncated == ((r.output, r.task, [tuple(a) for a in r.artifacts]) != (output or "", task or "", artifacts or []))
        if cap >= 600:
            assert r.input_tokens <= cap
    r = got[1]
    if cap == 8000:
        assert r.output == "o" * 9000 and r.task.startswith("t" * 1920) and "[truncated" not in r.output or r.output.startswith("o" * 100)
    assert not got[2].truncated or cap == 40
    assert [a.name for a in got[1].artifacts] == ["a", "b", "c"] or cap == 40


def test_head_and_tail(spark):
    text = "h" * 3000 + "t" * 3000
    got = projection.token_capped(spark.createDataFrame([(1, text, "", [])], SCHEMA), 1000).first()
    assert got.output == text[:960] + "\n...[truncated 1100 tokens]...\n" + text[-640:]


def test_view_of_a_transcript(spark):
    text = "# Run\n## Task\nDo it\n## Actions Taken\n1. a\n2. (decision) because I say so\n3. b\n## Outcome\nPassed\n## Duration\n5 min"
    df = spark.createDataFrame([("w", "2026-01-01-0000", text), ("w", "2026-01-02-0000", None)], "worker string, run_id string, text string")
    got = {r.run_id: r for r in projection.judged_view(df).collect()}
    r, none = got["2026-01-01-0000"], got["2026-01-02-0000"]
    assert (r.output, r.task, r.reasoning_stripped) == ("(no output recorded)", "Do it", True)
    assert [tuple(a) for a in r.artifacts] == [("actions_taken", "1. a\n3. b"), ("execution_record", "Passed\n5 min")]
    assert (none.output, none.task, none.artifacts, none.reasoning_stripped) == ("(no output recorded)", "(no task recorded)", [], False)


def test_ceiling(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([(5 * 86_400_000, 0.3), (86_400_000, 0.5), (86_400_001, 0.4), (None, 0.1), (0, 0.1)])], "id int, at long, c double")
    got = {r.id: r.running for r in projection.within_ceiling(df, "id", "at", df["c"], 1.0).collect()}
    assert got == {0: 0.3, 2: 0.7}
    assert len(projection.within_ceiling(df, "id", "at", df["c"], 5.0).collect()) == 5


def test_snapshots_stand_for_sessions_without_files(spark, tmp_path):
    line = lambda text: json.dumps({"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": text}}) + "\n"
    files = {"a.jsonl": line("own"), "a.checkpoint.1.jsonl": line("old") * 9, "b.checkpoint.1.jsonl": line("small"), "b.checkpoint.2.jsonl": line("larger text"), "c.trajectory.jsonl": "{}\n", "c.checkpoint.9.jsonl": line("x"), "d.checkpoint.y.jsonl": line("same"), "d.checkpoint.x.jsonl": line("same"), "e.checkpoint.1.txt": "no", "notes.md": "no"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.session_id: r.snapshot and r.snapshot.rsplit("/", 1)[1] for r in session_logs.list_sessions(spark, str(tmp_path)).collect()}
    assert got == {"a": None, "b": "b.checkpoint.2.jsonl", "c": None, "d": "d.checkpoint.x.jsonl"}
    read = sorted((r.session_id, r.message.content) for r in session_logs.read_logs(spark, str(tmp_path)).collect())
    assert read == [("a", "own"), ("b", "larger text"), ("d", "same")]
