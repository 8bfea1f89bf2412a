"""Literals for the session, trace and fleet operators."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import fleet, sessions, traces


def events(spark, *rows):
    """rows: (session, type, seconds, tokens, tool)"""
    seen: dict[str, int] = {}
    out = []
    for session, kind, at, tokens, tool in rows:
        seen[session] = seen.get(session, 0) + 1
        out.append((session, "w0", "m0", seen[session], at * 1000, kind, tokens, tool, f"{tool}(x)"))
    return spark.createDataFrame(out, "session_id string, worker string, model string, pos int, ts_ms long, type string, tokens long, tool long, tool_sig string")


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_issues_and_staleness(spark):
    e = events(spark, ("a", "output", 0, 1, 0), ("a", "end", 10, 1, 0), ("b", "heartbeat", 0, 1, 0), ("c", "output", 0, 1, 0), ("c", "output", 1000, 1, 0), ("c", "output", 2000, 1, 0))
    got = rows(sessions.issues(e), "session_id", "kind", "severity")
    assert set(got) == {("b", "no_output", "error"), ("b", "no_end", "warning"), ("b", "no_progress", "error"), ("c", "stale_gap", "warning"), ("c", "no_end", "warning")}
    assert got["c", "stale_gap", "warning"]["n"] == 2
    stale = rows(sessions.stale_sessions(e), "session_id")
    assert stale["c",]["stale"] == 1 and stale["b",]["stale"] == 1 and ("a",) not in stale


def test_heartbeats_over_the_limit(spark):
    e = events(spark, *[("a", "heartbeat", i, 1, 0) for i in range(6)], ("a", "output", 7, 1, 0), ("a", "end", 8, 1, 0))
    assert set(rows(sessions.issues(e), "kind", "severity")) == {("no_progress", "warning")}


def test_triage(spark):
    clean = [("clean", "output", 0, 5, 0), ("clean", "end", 5, 5, 0)]
    heavy = [("heavy", "output", 0, 1_500_000, 0), ("heavy", "end", 60, 0, 0)]
    loop = [("loop", "tool_call", i, 1, 1) for i in range(6)] + [("loop", "end", 9, 1, 0)]
    edits = [("edits", "tool_call", i, 1, i) for i in range(6)] + [("edits", "end", 9, 1, 0)]
    broken = [("broken", "error", 0, 1_200_000, 0)]
    got = rows(sessions.triage(events(spark, *clean, *heavy, *loop, *edits, *broken)), "session_id")
    assert {k[0]: v["kind"] for k, v in got.items()} == {"heavy": "over-cost", "loop": "loop-without-progress", "broken": "runaway"}
    assert got["heavy",]["costly"] == 1 and got["heavy",]["projected_usd"] == pytest.approx(13.5)


def test_retry_and_recovery(spark):
    e = events(spark, ("a", "error", 0, 1, 1), ("a", "error", 1, 1, 1), ("a", "tool_call", 2, 1, 2), ("a", "tool_call", 3, 1, 1), ("a", "tool_call", 4, 1, 3))
    got = traces.footprint(e).first()
    assert (got.tool_calls, got.tool_errors, got.error_rate, got.longest_streak, got.retry_count, got.recovered, got.unrecovered, got.recovery_rate) == (5, 2, 0.4, 2, 1, 2, 0, 1.0)


@pytest.mark.parametrize(
    ("series", "direction", "severity"),
    [
        ([0.95, 0.93, 0.96, 0.94, 0.6, 0.55, 0.5, 0.45], "degrading", "critical"),
        ([0.4, 0.45, 0.42, 0.44, 0.9, 0.92, 0.95, 0.93], "improving", "none"),
        ([0.8] * 8, "stable", "none"),
        ([0.9] * 4 + [0.88] * 4, "stable", "none"),
        ([0.95] * 4 + [0.3] * 4, "degrading", "critical"),
        ([0.9, 0.2], "insufficient-data", "none"),
    ],
)
def test_trends(spark, series, direction, severity):
    scores = spark.createDataFrame([("w", f"r{i}", i, "c", s, "pass") for i, s in enumerate(series)], "worker string, run_id string, started_ms long, check string, score double, status string")
    got = fleet.trends(scores).first()
    assert (got.direction, got.severity) == (direction, severity)


def test_upsert_keeps_the_last(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, v int, x string")
    assert {r.x for r in fleet.upsert_latest(df, ["key"], ["v"]).collect()} == {"new", "only"}


def test_text_metrics(spark):
    df = spark.createDataFrame([("a b a\n\nc\nc\nc", "x"), ("", None), (None, "x")], "t string, u string")
    got = df.select(T.count_words(F.col("t")), T.unique_word_ratio(F.col("t")), T.longest_duplicate_run(F.col("t")), T.count_paragraphs(F.col("t")), T.word_ngrams(F.col("t")), T.jaccard(F.col("t"), F.col("u"))).collect()
    assert tuple(got[0]) == (6, 0.5, 3, 2, ["a b a", "b a c", "a c c", "c c c"], 0.0)
    assert tuple(got[1]) == (0, None, 0, 0, [], 1.0)


def test_result_does_not_depend_on_partitions(spark):
    e = events(spark, *[("abc"[i % 3], ("output", "error", "tool_call", "heartbeat")[i % 4], i, i, i % 2) for i in range(60)])
    assert sorted(map(tuple, sessions.triage(e).collect())) == sorted(map(tuple, sessions.triage(e.repartition(7)).collect()))


def test_claims(spark):
    from tracewell.operators import claims

    said = spark.createDataFrame([("a", 1, "I pushed it, all tests pass"), ("b", 1, "Build passed"), ("c", 1, "hello"), ("d", 1, "it compiles")], "session_id string, pos int, text string")
    did = spark.createDataFrame([("a", "git_push", 0), ("a", "run_tests", 1), ("a", "run_tests", 0), ("b", "run_build", 1)], "session_id string, tool string, is_error int")
    got = rows(claims.cross_check(said, did), "session_id", "predicate")
    assert {k: v["verdict"] for k, v in got.items()} == {("a", "push"): "verified", ("a", "tests:pass"): "verified", ("b", "build:pass"): "contradicted", ("d", "build:pass"): "unverifiable"}
    integrity = rows(claims.claim_integrity(claims.cross_check(said, did)), "session_id")
    assert (integrity["a",]["integrity"], integrity["b",]["integrity"], integrity["d",]["integrity"]) == (1.0, 0.0, None)
