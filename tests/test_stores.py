"""JSON schemas, judges' answers, the score store, transcript facts and unified diffs on small cases."""

import datetime
import json

import pytest

from tracewell.functions import diffs, schemas
from tracewell.operators import fleet, judge
from tracewell.sources import score_store, transcripts

SCHEMA = {
    "type": "object", "required": ["name", "age"], "additionalProperties": False,
    "properties": {"name": {"type": "string", "minLength": 2, "pattern": "^[A-Z]"}, "age": {"type": "integer", "minimum": 0, "maximum": 150}, "tags": {"type": "array", "maxItems": 2, "items": {"enum": ["a", "b", 1]}}, "more": {"type": ["object", "null"], "properties": {}, "additionalProperties": {"type": "number"}}},
}


@pytest.mark.parametrize(
    "text, paths",
    [
        ('{"name": "Ann", "age": 3}', []),
        ('{"name": "Ann", "age": 3.0, "tags": ["a", 1], "more": {"x": 1.5}}', []),
        ('{"name": "a", "age": 200}', ["$.name", "$.name", "$.age"]),
        ('{"age": true, "other": 1}', ["$.name", "$.age", "$.other"]),
        ('{"name": "Ann", "age": 1.5, "tags": ["a", "c", true]}', ["$.age", "$.tags", "$.tags[1]", "$.tags[2]"]),
        ('{"name": "Ann", "age": 1, "more": {"x": "1"}}', ["$.more.x"]),
        ("[1]", ["$"]), ("{", ["$"]), ("NaN", ["$"]), (None, ["$"]),
    ],
)
def test_schema(spark, text, paths):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(schemas.schema_problems(df["t"], SCHEMA).alias("p"), schemas.matches_schema(df["t"], SCHEMA).alias("ok")).first()
    assert [x.path for x in r.p] == paths and r.ok == (not paths)


def test_answers_of_judges(spark):
    one = '{"scores": [{"criterionId": "a", "score": 4, "confidence": 2, "evidence": ["x"]}, {"criterionId": "b", "score": "bad", "confidence": null}, {"criterionId": "zz", "score": 1}], "summary": "with } and \\" inside"}'
    rows = [(1, one), (2, f"Sure:\n```json\n{one}\n```"), (3, f"My view is {one} as said."), (4, "no idea"), (5, '{"scores": 3}'), (6, None), (7, "```\n{broken\n```")]
    df = spark.createDataFrame(rows, "id int, response string")
    got = judge.parse_responses(df, "id")
    assert {(r.id, r.criterion, r.score, r.confidence) for r in got.collect()} == {(i, c, s, f) for i in (1, 2, 3) for c, s, f in (("a", 4.0, 1.0), ("b", 0.0, 0.5), ("zz", 1.0, 0.5))}
    assert {r.id: r.problem for r in judge.unreadable(df, "id").collect()} == {4: "no JSON", 5: "no list of scores", 6: "no JSON", 7: "not valid JSON"}
    rubric = spark.createDataFrame([("a", 3.0, 1.0, 5.0), ("c", 1.0, 0.0, 1.0)], "criterion string, weight double, low double, high double")
    scores = judge.rubric_scores(got.where("id = 1"), rubric, "id")
    assert {r.criterion: (r.score, r.confidence) for r in scores.collect()} == {"a": (0.75, 1.0), "c": (0.0, 0.0)}
    v = judge.weighted_verdicts(scores, "id").first()
    assert (v.score, v.confidence, v.verdict) == (0.5625, 0.75, "fail")


def test_rubrics(spark):
    levels = spark.createDataFrame([("a", 3.0, 1), ("a", 3.0, 5), ("b", None, 0), ("b", None, 1), ("c", -1.0, 2), ("", 1.0, 1), ("", 1.0, 1)], "criterion string, weight double, level int")
    good = judge.rubric_of(levels.where("criterion in ('a', 'b')"))
    assert {r.criterion: (r.weight, r.low, r.high) for r in good.collect()} == {"a": (0.75, 1.0, 5.0), "b": (0.25, 0.0, 1.0)}
    assert {(r.criterion, r.problem) for r in judge.rubric_problems(levels).collect()} == {("c", "has fewer than two levels"), ("c", "has no positive weight"), ("", "has no name"), ("", "has a level twice")}
    parsed = spark.createDataFrame([(1, "a", 5.0, 0.9), (1, "b", 1.0, 0.9), (2, "a", 5.0, 0.9)], "id int, criterion string, score double, confidence double")
    scores = judge.rubric_scores(parsed, good, "id")
    got = {r.id: tuple(r)[1:] for r in judge.verdict_assertions(judge.weighted_verdicts(scores, "id"), scores, "id").collect()}
    assert got == {1: (True, True, True, "a"), 2: (False, False, False, "b")}


def test_score_store(spark, tmp_path):
    root = f"file://{tmp_path}/scores"
    assert score_store.read_scores(spark, root).count() == 0
    (tmp_path / "scores" / "w1").mkdir(parents=True)
    row = lambda w, run, check, score, at=1: {"worker": w, "runId": run, "check": check, "score": score, "status": "pass", "startedAt": "2026-01-01", "startedAtMs": at, "detail": {"durationMs": 5}}
    (tmp_path / "scores" / "w1" / "scores.jsonl").write_text("\n".join([json.dumps(row("w1", "r1", "a", 0.5)), "{broken", json.dumps({"worker": "w1"}), ""]))
    rows = lambda *r: score_store.parse_scores(spark.createDataFrame([(json.dumps(x),) for x in r], "value string"))
    table = lambda: {(r.worker, r.runId, r.check): r.score for r in score_store.read_scores(spark, root).collect()}
    assert table() == {("w1", "r1", "a"): 0.5}
    assert score_store.write_scores(rows(row("w1", "r1", "a", 0.9), row("w2", "r1", "a", 0.1, 1), row("w2", "r1", "a", 0.2, 2)), root) == {"added": 1, "replaced": 1, "total": 2}
    assert table() == {("w1", "r1", "a"): 0.9, ("w2", "r1", "a"): 0.2}
    assert score_store.write_scores(rows(row("w3", "r1", "b", 1.0)), root, "append")["total"] == 3
    assert json.loads(score_store.read_scores(spark, root).where("worker = 'w3'").first().detail) == {"durationMs": 5}
    assert score_store.write_scores(rows(row("w3", "r1", "b", 0.0)), root, "replace") == {"added": 1, "replaced": 0, "total": 1}


@pytest.mark.parametrize(
    "body, minutes",
    [("09:00 - 10:30", 90), ("23:50 to 00:10", 20), ("about 2h 15m", 135), ("1.5 hours", 90), ("90 s", 1.5), ("45", 45), ("roughly 12 things", 12), ("25:99 - 26:00 5 min", 5), ("", None), ("none", None), (None, None)],
)
def test_durations(spark, body, minutes):
    got = spark.createDataFrame([(body,)], "b string").select(transcripts.duration_ms(transcripts.F.col("b")).alias("d")).first().d
    assert got == (None if minutes is None else minutes * 60_000)


def test_transcript_facts(spark):
    text = "# Nightly run\n\n## Task\nDo it\n## Actions Taken\n1. one\n   goes on\n- two\n\nnot an item\n* three\n## Outcome\n\n**Passed** with notes\n## Errors & Retries\nN/A\n## Duration\n10:00 - 10:05\n"
    df = spark.createDataFrame([("w", "r", text), ("w", "s", "text first\n# late title\n## Outcome\nhmm\n## Errors & Retries\nTwo timeouts happened"), ("w", "t", None)], "worker string, run_id string, text string").selectExpr("*", "DATE'2026-01-01' AS date")
    got = {r.run_id: r for r in transcripts.facts(df).collect()}
    r, s, t = got["r"], got["s"], got["t"]
    assert (r.title, r.actions, r.outcome, r.had_errors, r.duration_ms, r.n_missing) == ("Nightly run", 3, "pass", False, 300_000.0, 1)
    assert (s.title, s.actions, s.outcome, s.had_errors, s.duration_ms) == ("", 0, "unknown", True, None) and (t.title, t.outcome, t.n_missing) == ("", "unknown", 5)
    items = df.where("run_id = 'r'").select(transcripts.list_items(transcripts.F.lit("1. one\n   goes on\n- two\n\nlost\n* three")).alias("x")).first().x
    assert items == ["one goes on", "two", "three"]


def test_transcripts_to_scores(spark):
    good = "# Nightly\n## Task\nx\n## Actions Taken\n- a\n- b\n- c\n## Outcome\nPassed\n## Duration\n40 min\n"
    bad = "## Actions Taken\n## Outcome\nFailed\n## Errors & Retries\nTwo timeouts happened\n## Duration\n2 min"
    df = spark.createDataFrame([("w", "2026-03-07-0100", good), ("w", "2026-03-08-0500", bad), ("v", "2026-07-01-1200", "nothing")], "worker string, run_id string, text string").selectExpr("*", "DATE'2026-01-01' AS date")
    events = transcripts.timeline(df, "America/Los_Angeles").cache()
    got = {}
    for r in events.orderBy("session_id", "pos").collect():
        got.setdefault(r.session_id, []).append((r.type, r.ts_ms, r.text))
    utc = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp() * 1000)
    t, u = utc(2026, 3, 7, 9, 0), utc(2026, 3, 8, 12, 0)  # before and after the clocks change
    assert got["w/2026-03-07-0100"] == [("start", t, "Nightly"), ("output", t + 600_000, "a"), ("output", t + 1_200_000, "b"), ("output", t + 1_800_000, "c"), ("end", t + 2_400_000, "pass")]
    assert got["w/2026-03-08-0500"] == [("start", u, "w run"), ("error", u + 119_999, "Two timeouts happened"), ("end", u + 120_000, "fail")] and len(got["v/2026-07-01-1200"]) == 1
    scores = {(r.run_id[2:12], r.check): (r.score, r.status) for r in fleet.check_scores(events).collect()}
    assert scores["2026-03-07", "staleness"] == (0.4, "fail") and scores["2026-03-07", "verification"] == (1.0, "pass")  # four gaps of ten minutes
    assert scores["2026-03-08", "verification"] == (0.4, "fail") and scores["2026-03-08", "staleness"] == (0.5, "fail") and scores["2026-07-01", "staleness"][1] == "fail"


def test_unified_diffs(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n line\n-old\n+new\n+more\n--- text that was removed\n@@ -9 +9 @@\n-a\n+b\n--- a/gone.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-bye"
    df = spark.createDataFrame([(1, diff), (2, ""), (3, None), (4, "+only\n-lines")], "id int, diff string")
    got = {(r.id, r.file): (r.hunks, r.added, r.removed) for r in diffs.unified_changes(df, "id").collect()}
    assert got == {(1, "x.py"): (2, 3, 3), (1, "gone.txt"): (1, 0, 1), (4, ""): (0, 1, 1)}
