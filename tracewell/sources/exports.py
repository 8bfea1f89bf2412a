"""Readers of trace exports: one row a session in the shape of `operators.sessions.sessions`, as far as the export tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "STRUCT<stringValue: STRING, intValue: STRING, doubleValue: DOUBLE, boolValue: BOOLEAN, arrayValue: STRUCT<values: ARRAY<STRUCT<stringValue: STRING>>>>"
_ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {_VALUE}>>"
_SPAN = f"STRUCT<traceId: STRING, spanId: STRING, name: STRING, startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {_ATTRIBUTES}, status: STRUCT<code: STRING, message: STRING>, events: ARRAY<STRUCT<name: STRING, attributes: {_ATTRIBUTES}>>>"
OTLP = f"resourceSpans ARRAY<STRUCT<scopeSpans: ARRAY<STRUCT<spans: ARRAY<{_SPAN}>>>>>"
LANGSMITH = "id STRING, trace_id STRING, parent_run_id STRING, name STRING, run_type STRING, start_time STRING, end_time STRING, status STRING, error STRING, total_tokens LONG, prompt_tokens LONG, completion_tokens LONG, inputs STRING, outputs STRING"
#: Finish reasons that mean a cap was hit, and words of a timeout.
CAPPED = ["length", "max_tokens", "model_length"]
TIMEOUT = "(?i)time(d)?[ -]?out|deadline"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON export: an array, one object, or one object a line. Lines that do not parse are dropped. Files that hold one array or object over several lines are read whole."""
    return spark.read.schema(schema).option("multiLine", "true").json(path) if not path.endswith((".jsonl", ".ndjson")) else spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _last(key: str) -> Column:
    """The place of a key's last value among `keys` and `values`, from 0; -1 if it is not there."""
    return (F.array_position("keys", F.lit(key)) - 1).cast("int")


def _attribute(*keys: str) -> Column:
    """The last value of the first key that is there, as text."""
    return F.coalesce(*(F.get("texts", _last(k)) for k in keys))


def otlp_spans(exports: DataFrame) -> DataFrame:
    """Spans of OTLP exports, three levels down, with the attributes that sessions need."""
    # a plain explode infers a filter on its array, pushed down to where the array is made: a parsed column would be parsed for it again
    resource = exports.select(F.posexplode_outer("resourceSpans").alias("i", "r")).where("i is not null")
    span = resource.select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("span")).select("span.*")
    span = span.withColumn("attributes", F.coalesce("attributes", F.array().cast(_ATTRIBUTES))).withColumn("events", F.coalesce("events", F.array().cast(f"ARRAY<STRUCT<name: STRING, attributes: {_ATTRIBUTES}>>")))
    # attributes are gone through once: keys, values and their texts, the last first; what is looked up is found by its place
    span = span.withColumns({"keys": F.reverse(F.col("attributes.key")), "values": F.reverse(F.col("attributes.value"))})
    span = span.withColumn("texts", F.transform("values", lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))))
    number = lambda *k: F.coalesce(_attribute(k[0]).try_cast("long"), _attribute(k[1]).try_cast("long"), F.lit(0).cast("long"))
    reasons = F.get("values", _last("gen_ai.response.finish_reasons"))
    listed = F.coalesce(F.transform(reasons["arrayValue"]["values"], lambda v: v["stringValue"]), F.when(reasons["stringValue"].isNotNull(), F.array(reasons["stringValue"])), F.array().cast("array<string>"))
    # nanoseconds have more digits than a double
    millis = lambda c: F.floor(F.col(c).try_cast("decimal(24,0)") / 1_000_000).cast("long")
    failed = F.coalesce(F.col("status.code").isin("STATUS_CODE_ERROR", "2"), F.lit(False)) | F.exists("events", lambda e: e["name"] == "exception")
    return span.select(
        F.coalesce(_attribute("gen_ai.conversation.id", "session.id"), F.col("traceId")).alias("session_id"),
        "name",
        "spanId",
        _attribute("gen_ai.response.model", "gen_ai.request.model").alias("model"),
        F.coalesce(_attribute("gen_ai.tool.name", "code.function.name"), F.col("name")).alias("tool"),
        _attribute("gen_ai.tool.call.arguments", "gen_ai.tool.arguments", "gen_ai.tool.input").alias("arguments"),
        millis("startTimeUnixNano").alias("start_ms"),
        millis("endTimeUnixNano").alias("end_ms"),
        (number("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens") + number("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens")).alias("tokens"),
        F.arrays_overlap(listed, F.array(*map(F.lit, CAPPED))).alias("capped"),
        failed.alias("failed"),
        (_attribute("gen_ai.operation.name") == "execute_tool").alias("is_tool"),
    )


def otlp_sessions(exports: DataFrame) -> DataFrame:
    return span_sessions(otlp_spans(exports))


def span_sessions(spans: DataFrame) -> DataFrame:
    """One row a conversation: clean if no span failed and all ended; timed out if a finish reason is a cap."""
    agg = spans.groupBy("session_id").agg(
        F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.count("*").alias("n_events"), F.count_if("failed").alias("n_errors"), F.sum("tokens").alias("tokens"),
        F.count_if(F.coalesce("is_tool", F.lit(False)) & ~F.col("failed")).alias("n_tool_calls"), F.max(F.coalesce("capped", F.lit(False)).cast("int")).alias("timed_out"), F.max(F.col("end_ms").isNull().cast("int")).alias("unfinished"),
    )
    return agg.withColumn("clean", ((F.col("n_errors") == 0) & (F.col("unfinished") == 0)).cast("int"))


def langsmith_sessions(runs: DataFrame) -> DataFrame:
    """One row a trace: tokens of its model runs, or of its root if those have none; clean as the root and the rest say."""
    own = F.coalesce("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    millis = lambda c: F.unix_millis(F.try_to_timestamp(F.col(c)))
    df = runs.where("id is not null").withColumn("session_id", F.coalesce("trace_id", "id")).withColumn("root", F.col("parent_run_id").isNull()).withColumn("own", own)
    failed = F.col("error").isNotNull() | (F.col("status") == "error")
    agg = df.groupBy("session_id").agg(
        F.max(F.when(F.col("root"), F.col("name"))).alias("label"),
        F.min(millis("start_time")).alias("first_ms"), F.max(millis("end_time")).alias("last_ms"), F.count("*").alias("n_events"), F.count_if(failed).alias("n_errors"), F.count_if(F.col("run_type") == "tool").alias("n_tool_calls"),
        F.sum(F.when(F.col("run_type") == "llm", F.col("own")).otherwise(0)).alias("model_tokens"), F.max(F.when(F.col("root"), F.col("own"))).alias("root_tokens"),
        F.max(F.coalesce(F.col("error").rlike(TIMEOUT), F.lit(False)).cast("int")).alias("timed_out"), F.max(F.col("end_time").isNull().cast("int")).alias("unfinished"),
    )
    tokens = F.when(F.col("model_tokens") > 0, F.col("model_tokens")).otherwise(F.coalesce("root_tokens", F.lit(0)))
    return agg.withColumn("tokens", tokens).withColumn("clean", ((F.col("n_errors") == 0) & (F.col("unfinished") == 0)).cast("int")).drop("model_tokens", "root_tokens")


#: Types of a run's fields other than text.
_LONGS = ["total_tokens", "prompt_tokens", "completion_tokens"]


def langsmith_runs(texts: DataFrame, column: str = "value", lines: bool = False) -> DataFrame:
    """Runs (LANGSMITH) out of exports of any form, each a text: an array of runs, {"runs": [...]}, one run, an object of runs by any keys, or a run or an array of runs a line; lines: each row is such a line.

    All forms are told apart in one plan by VARIANT: what does not parse as a whole is taken line by line, and lines that do not parse go. A broken array is no lines and raises. Values that are no objects go; fields of other types become null, inputs and outputs JSON text.
    """
    blank = " \t\n\x0b\f\r"
    trimmed = F.rtrim(F.ltrim(F.coalesce(F.col(column), F.lit("")), F.lit(blank + "\ufeff")), F.lit(blank))
    text = F.col("text")
    # the parser reads one value and leaves what follows it, so a text whose first line is a value of its own is taken by lines
    single = F.lit(lines) | ~text.contains("\n") | F.try_parse_json(F.substring_index(text, "\n", 1)).isNull()
    rows = texts.select(trimmed.alias("text")).select("text", F.when(single, F.try_parse_json(text)).alias("whole"))
    # a run's fields are read together and straight from the text's value; what is no object becomes null
    run = f"struct<{', '.join(f'{c.split()[0]}: {"long" if c.split()[0] in _LONGS else "string"}' for c in LANGSMITH.split(', '))}>"
    listed = lambda v, path="$": F.try_variant_get(v, path, f"array<{run}>")
    alone = lambda v: F.array(F.try_variant_get(v, "$", run))
    of_line = lambda v: F.coalesce(listed(v), alone(v))
    whole, none = F.col("whole"), F.array().cast(f"array<{run}>")
    if lines:
        found = F.when(whole.isNull(), none).otherwise(of_line(whole))
    else:
        one = F.coalesce(listed(whole), listed(whole, "$.runs"), F.when(F.coalesce(F.try_variant_get(whole, "$.id", "string"), F.lit("")) != "", alone(whole)), F.map_values(F.try_variant_get(whole, "$", f"map<string, {run}>")), none)
        parts = F.filter(F.transform(F.split("text", "\\r?\\n"), F.try_parse_json), lambda v: v.isNotNull())
        broken = F.raise_error(F.lit("an export that begins as an array is no JSON")).cast(f"array<{run}>")
        # one column and one explode for all forms, so that a text is read and parsed once
        found = F.when(whole.isNotNull(), one).when(text.startswith("["), broken).otherwise(F.flatten(F.transform(parts, of_line)))
    return rows.select(F.explode(found).alias("run")).where("run is not null").select("run.*")
