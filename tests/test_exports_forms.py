"""One set of runs in each form of a run export."""

import json

import pytest

from tracewell.sources import built, exports

RUNS = [
    {"id": "a", "trace_id": "t", "name": "root", "run_type": "chain", "start_time": "2026-01-01T00:00:00Z", "end_time": "2026-01-01T00:01:00Z", "inputs": {"x": [1, {"y": "z"}]}, "outputs": "plain"},
    {"id": "b", "trace_id": "t", "parent_run_id": "a", "name": "model", "run_type": "llm", "total_tokens": 12, "start_time": "2026-01-01T00:00:10Z", "end_time": "2026-01-01T00:00:20Z"},
    {"id": "c", "run_type": "tool", "name": "search", "total_tokens": "no number", "error": "timed out", "start_time": "2026-01-02T00:00:00Z"},
]
FORMS = {
    "array": json.dumps(RUNS, indent=1),
    "runs": json.dumps({"meta": 1, "runs": RUNS}),
    "by key": json.dumps({"k1": RUNS[0], "other": 5, "k2": RUNS[1], "k3": RUNS[2]}),
    "lines": "\n".join(map(json.dumps, RUNS)) + "\n{broken\n\n",
    "arrays by line": json.dumps(RUNS[:2]) + "\r\n" + json.dumps(RUNS[2]),
    "with others": "﻿  " + json.dumps([1, "x", None, [], *RUNS]),
}
FORMS["arrays by line"] = json.dumps(RUNS[2]) + "\r\n" + json.dumps(RUNS[:2])


def read(spark, text, **options):
    return exports.langsmith_runs(spark.createDataFrame([(text,)], "value string"), **options)


@pytest.mark.parametrize("form", FORMS)
def test_forms(spark, form):
    df = read(spark, FORMS[form])
    got = sorted(df.collect())
    assert [(r.id, r.trace_id, r.total_tokens) for r in got] == [("a", "t", None), ("b", "t", 12), ("c", None, None)]
    assert json.loads(got[0].inputs) == {"x": [1, {"y": "z"}]} and got[0].outputs == "plain" and got[2].error == "timed out"
    assert {(r.session_id, r.kind) for r in built.triage(built.langsmith(df), stale_only=False).collect()} == {("c", "timeout")}


def test_one_run_and_nothing(spark):
    assert [r.id for r in read(spark, json.dumps(RUNS[1])).collect()] == ["b"]
    assert read(spark, " ").count() == read(spark, None).count() == read(spark, "5").count() == read(spark, "{}").count() == read(spark, "no json\n{also}").count() == 0
    lines = spark.createDataFrame([(json.dumps(r),) for r in RUNS] + [("[1",), (json.dumps([RUNS[0]]),)], "value string")
    assert sorted(r.id for r in exports.langsmith_runs(lines, lines=True).collect()) == ["a", "a", "b", "c"]
    with pytest.raises(Exception, match="begins as an array"):
        read(spark, '[{"id": "a"}, {').collect()
