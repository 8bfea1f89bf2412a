"""Triage parses its source once, however often it uses what was parsed."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.sources import built, exports


def counted(spark, df):
    """df, and an accumulator of how many of its rows were read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema), seen


def test_run_exports(spark):
    run = lambda t, i, **x: {"id": f"{t}{i}", "trace_id": t, "name": "grep", "run_type": "llm", "start_time": f"2026-01-01T00:0{i}:00Z", "end_time": f"2026-01-01T00:0{i}:30Z", "outputs": f"part {9 - i} of it"} | x
    texts = [json.dumps([run("a", i, total_tokens=400_000) for i in range(5)]), "\n".join(json.dumps(run("b", i, error="it timed out")) for i in range(3)), json.dumps({"k": run("c", 0), "l": run("c", 1)})]
    df, seen = counted(spark, spark.createDataFrame([(t,) for t in texts], "value string"))
    sessions = built.langsmith(exports.langsmith_runs(df))
    assert {(r.session_id, r.kind, r.tokens) for r in built.triage(sessions).collect()} == {("a", "over-cost", 2_000_000), ("b", "timeout", 0)}
    assert seen.value == len(texts)
    # texts keep the order of time
    assert [r.text for r in sessions.texts.where("session_id = 'c'").orderBy("place").collect()] == ["part 9 of it", "part 8 of it"]


def test_span_exports(spark):
    """The source is read once, and JSON in a column is parsed once a row: no filter repeats it."""
    span = lambda t, i, *attributes: {"traceId": t, "spanId": f"{t}{i}", "name": "chat", "startTimeUnixNano": f"{i}000000000", "endTimeUnixNano": f"{i + 1}000000000", "attributes": [{"key": k, "value": v} for k, v in attributes], "status": {"code": "STATUS_CODE_OK"}}
    used = ("gen_ai.usage.output_tokens", {"intValue": "700000"})
    spans = [span("a", 0, used), span("a", 1, ("gen_ai.usage.output_tokens", {"intValue": "5"}), used), span("b", 0), span("b", 1, ("session.id", {"stringValue": "a"}), (None, {"intValue": "1"}))]
    texts = [json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [s]}]}]}) for s in spans] + ['{"resourceSpans": []}', "{}"]
    df, seen = counted(spark, spark.createDataFrame([(t,) for t in texts], "value string"))
    parsed = df.select(F.from_json("value", exports.OTLP)["resourceSpans"].alias("resourceSpans"))
    assert exports.otlp_spans(parsed)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {(r.session_id, r.kind, r.tokens) for r in built.triage(built.otlp(parsed)).collect()} == {("a", "over-cost", 1_400_000)}
    assert seen.value == len(texts)
