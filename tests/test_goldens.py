"""Results that are known beforehand: sessions, footprints, trends and grades of small invented inputs whose outcome is fixed, not computed by a second engine."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import repetition
from tracewell.operators import fleet, sessions, traces
from tracewell.sources import built, session_logs

DAY = 86_400_000
BASE = 1_780_000_000_000


def iso(minute):
    return f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


def message(minute, role, content, **x):
    return {"type": "message", "timestamp": iso(minute), "message": {"role": role, "content": content} | x}


def says(text):
    return [{"type": "text", "text": text}]


def calls(*pairs):
    return [{"type": "toolCall", "name": n, "arguments": a} for n, a in pairs]


TASK, STOP = message(0, "user", "Please do the task"), {"stopReason": "stop"}
FILES = {
    "burner": [TASK, message(1, "assistant", calls(("run", {"i": 1})), usage={"totalTokens": 15_500_000}), {"type": "custom", "timestamp": iso(50), "customType": "prompt-error", "data": {"error": "LLM idle timeout"}}],
    "abandon": [TASK, message(3, "assistant", says("I will look at the"), usage={"totalTokens": 450_000}, stopReason="aborted")],
    "clean": [TASK, message(1, "assistant", says("Here is the result, all is done."), usage={"totalTokens": 900}, **STOP)],
    "heavy": [TASK, *(message(m, "assistant", says(f"Part {m} of the report is written now."), usage={"totalTokens": 1_600_000}) for m in (4, 8, 12, 16, 20)), message(45, "assistant", says("Finished."), usage={"totalTokens": 1_600_000}, **STOP)],
    "looper": [TASK, *(message(m, "assistant", says("Let me check the configuration file for errors again.")) for m in range(1, 7)), message(8, "assistant", says("Done."), **STOP)],
    "toolthrash": [TASK, *(message(m, "assistant", calls(("bash", {"command": "npm test"}))) for m in range(1, 7)), message(8, "assistant", says("Done."), **STOP)],
    "manyedits": [TASK, *(message(m, "assistant", calls(("edit", {"path": f"src/file{m}.ts"}))) for m in range(1, 7)), message(8, "assistant", says("Done."), **STOP)],
    "oneturn": [TASK, message(1, "assistant", calls(*(("bash", {"command": "ls"}) for _ in range(5)))), message(2, "assistant", says("Done."), **STOP)],
}
TRAJECTORIES = {"burner": [{"ts": iso(50), "data": {"idleTimedOut": True}}], "abandon": [{"ts": iso(3), "data": {"aborted": True}}]}


@pytest.fixture(scope="module")
def triaged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sessions")
    for name, lines in FILES.items():
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    for name, lines in TRAJECTORIES.items():
        (folder / f"{name}.trajectory.jsonl").write_text("\n".join(map(json.dumps, lines)))
    logs = session_logs.read_lines(spark, [str(folder / f"{n}.jsonl") for n in FILES], session_logs.LOG)
    return built.triage(built.logs(logs, session_logs.read_lines(spark, f"{folder}/*.trajectory.jsonl", session_logs.TRAJECTORY))).cache()


def test_sessions_are_triaged(triaged):
    got = {r.session_id: r for r in triaged.collect()}
    assert {k: r.kind for k, r in got.items()} == {"burner": "timeout", "abandon": "abandoned", "heavy": "over-cost", "looper": "loop-without-progress", "toolthrash": "loop-without-progress", "oneturn": "loop-without-progress"}
    assert {k for k, r in got.items() if r.costly} == {"burner", "abandon", "heavy"} and got["heavy"].issue_kinds == "over-cost,over-latency"
    assert sessions.triage_top(triaged, 1).first().session_id == "burner"


def test_triage_totals(triaged):
    t = sessions.triage_totals(triaged).first()
    assert (t.flagged, t.costly) == (6, 3) and t.projected_usd == pytest.approx((15.5 + 0.45 + 1.6) * 9) and t.projected_usd > 150


def outcomes(spark, *runs):
    """A session for each list of tools, an E behind a tool that failed."""
    rows = [(f"s{i}", "m", p, t.split()[0], int(t.endswith(" E")), 1) for i, run in enumerate(runs) for p, t in enumerate(run, 1)]
    return spark.createDataFrame(rows, "session_id string, model string, pos long, tool string, is_error int, tokens long")


def test_footprints(spark):
    df = traces._measured(traces._runs(outcomes(spark, ["run_command", "git_push"], ["run_build E", "run_build E", "edit_file", "run_build", "git_push"], ["run_build E"] * 3, ["run_build", "run_tests", "git_push E"])))
    got = {r.session_id: (r.tool_calls, r.tool_errors, r.error_rate, r.longest_streak, r.retry_count, r.recovered, r.unrecovered, r.recovery_rate) for r in df.collect()}
    assert got["s0"] == (2, 0, 0.0, 0, 0, 0, 0, 1.0) and got["s1"] == (5, 2, 0.4, 2, 1, 2, 0, 1.0)
    assert got["s2"] == (3, 3, 1.0, 3, 2, 0, 2, 0.0) and got["s3"][:2] == (3, 1) and got["s3"][5:7] == (0, 0)


TRENDS = {
    "falls": ([0.95, 0.93, 0.96, 0.94, 0.6, 0.55, 0.5, 0.45], "degrading", "critical"),
    "rises": ([0.4, 0.45, 0.42, 0.44, 0.9, 0.92, 0.95, 0.93], "improving", "none"),
    "flat": ([0.8] * 8, "stable", "none"),
    "little": ([0.9] * 4 + [0.88] * 4, "stable", "none"),
    "cliff": ([0.95] * 4 + [0.3] * 4, "degrading", "critical"),
    "few": ([0.9, 0.1], "insufficient-data", "none"),
    "one": ([0.9], "insufficient-data", "none"),
    "wide": ([0.9, 0.5, 0.9, 0.5, 0.45, 0.45, 0.45, 0.45], "degrading", "warning"),
    "tiny": ([0.5, 0.5 + 4e-7, 0.5, 0.5 + 4e-7, 0.5 + 3e-7] + [0.5 + 3e-7] * 3, "stable", "none"),
}


def series(spark, values, status="pass"):
    rows = [(k, "c", f"r{i}", BASE + i * DAY // 2, v, status) for k, vs in values.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "worker string, check string, run_id string, started_ms long, score double, status string")


def test_trends(spark):
    got = {r.worker: r for r in fleet.trends(series(spark, {k: v[0] for k, v in TRENDS.items()})).collect()}
    assert {k: (r.direction, r.severity) for k, r in got.items()} == {k: v[1:] for k, v in TRENDS.items()}
    assert got["cliff"].z == -99.0 and got["falls"].n_base == 4 and got["wide"].z == pytest.approx(-1.25)
    gentle = {r.worker: r.severity for r in fleet.trends(series(spark, {"wide": TRENDS["wide"][0]}), warning_z=2.0).collect()}
    assert gentle == {"wide": "info"}


def test_trends_of_other_metrics(spark):
    rows = series(spark, {"w": [1.0] * 6}).withColumn("status", F.when(F.col("run_id") > "r2", "fail").otherwise("pass")).withColumn("durationMs", F.when(F.col("run_id") == "r0", -1).otherwise(F.when(F.col("run_id") > "r2", 900).otherwise(1000)))
    fails, durations = (fleet.trends(rows, m).first() for m in ("failRate", "durationMs"))
    assert (fails.direction, fails.mean_base, fails.mean_recent) == ("degrading", 0.0, 1.0) and (durations.n_base + durations.n_recent, durations.direction) == (5, "improving")


def test_grades(spark):
    rows = []
    for worker, fails, n in (("healthy", 1, 10), ("watch", 2, 10), ("low", 6, 10), ("none", 0, 3)):
        rows += [(worker, "c", f"r{i:02d}", BASE + i, 0.9, "fail" if i < fails else "pass") for i in range(n)]
    rows += [("falling", "c", f"r{i}", BASE + i * DAY, 0.95 if i < 4 else 0.3, "pass") for i in range(8)]
    df = spark.createDataFrame(rows, "worker string, check string, run_id string, started_ms long, score double, status string")
    assert {r.worker: r.grade for r in fleet.scorecard(df).collect()} == {"healthy": "healthy", "watch": "watch", "low": "at-risk", "none": "healthy", "falling": "at-risk"}


def test_upsert_and_dates(spark):
    rows = spark.createDataFrame([("a", 1, None, "old"), ("a", 1, 2, "new"), ("a", 1, 1, "mid"), ("b", None, 1, "x")], "k string, l int, v int, what string")
    assert {(r.k, r.what) for r in fleet.upsert_latest(rows, ["k", "l"], ["v"]).collect()} == {("a", "new"), ("b", "x")}
    days = series(spark, {"w": [0.5] * 6})
    assert fleet.in_dates(days, "2026-05-29", "2026-05-29").count() == days.where("date(timestamp_millis(started_ms)) = '2026-05-29'").count() > 0


def test_repeated_segments_against_all_pairs():
    rng = random.Random(2)
    words = [f"word{i}" for i in range(30)]
    found = []
    for _ in range(300):
        base = rng.choice(found).split() if found and rng.random() < 0.6 else rng.choices(words, k=rng.randint(6, 20))
        found.append(" ".join(w if rng.random() < 0.96 else rng.choice(words) for w in base))
    heads = []
    for s in found:
        if not any(repetition._similar(s, h) for h in heads) and s not in heads:
            heads.append(s)
    assert repetition.repeated(found)["unique"] == len(heads)
