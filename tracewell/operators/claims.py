"""What an agent said against what its harness recorded: provenance of each field, and claims cross-checked with tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Who vouches for a field (proof: the harness; claim: the model; else neutral).
PROVENANCE = {
    "event_type": "proof",
    "timestamp": "proof",
    "duration_ms": "proof",
    "tokens_in": "proof",
    "tokens_out": "proof",
    "tool_call.tool_output": "proof",
    "tool_call.duration_ms": "proof",
    "tool_call.timestamp": "proof",
    "decision_trace.timestamp": "proof",
    "tool_call.tool_name": "claim",
    "tool_call.tool_input": "claim",
    "decision_trace.reasoning": "claim",
    "decision_trace.alternatives_considered": "claim",
    "decision_trace.confidence": "claim",
}
TOOL_EVENTS = ["tool_call", "tool_result"]
# Phrases that claim a result, and what the names of tools that prove it contain.
PREDICATES = [
    ("push", ["pushed", "push to", "i push", "pushing"], ["push"]),
    ("build:pass", ["rebuilt green", "build passed", "built green", "build succeeded", "build is green", "compiles"], ["build", "compile"]),
    ("tests:pass", ["tests pass", "tests passed", "tests are green", "all tests pass", "test suite green"], ["test"]),
    ("score:green", ["score was", "scored", "is green", "passed the gate", "(green)"], ["score"]),
]

# What the text of a result that proves a predicate contains, and the keys of a result that hold text.
PROOF_WORDS = {"score:green": ["score="]}
RESULT_TEXTS = ["stdout", "stderr", "output", "result", "message"]


def provenance_of(path: str | Column, event_type: str | Column) -> Column:
    path, event_type = (F.col(c) if isinstance(c, str) else c for c in (path, event_type))
    fixed = F.create_map(*(F.lit(x) for kv in PROVENANCE.items() for x in kv))
    output = F.when(event_type.isin(TOOL_EVENTS), "proof").otherwise("claim")
    return F.when(path == "output_data", output).otherwise(F.coalesce(fixed[path], F.lit("neutral")))


def unpivot(events: DataFrame, paths: dict[str, Column]) -> DataFrame:
    """(session_id, pos, type, path, provenance, value): a row for each field that an event has."""
    cells = F.array(*(F.struct(F.lit(p).alias("path"), c.cast("string").alias("value")) for p, c in paths.items()))
    long = events.select("session_id", "pos", "type", F.explode(cells).alias("cell")).select("session_id", "pos", "type", "cell.path", "cell.value").where("value is not null")
    return long.withColumn("provenance", provenance_of("path", "type"))


def run_event_fields(events: DataFrame) -> DataFrame:
    called = F.col("type") == "tool_call"
    fields = {"event_type": F.col("type"), "timestamp": F.col("ts_ms"), "tokens_in": F.col("tokens"), "session_id": F.col("session_id"), "model": F.col("model"), "tool_call.tool_name": F.when(called, F.col("tool")), "tool_call.tool_input": F.when(called, F.col("tool_sig")), "output_data": F.col("tool_sig")}
    return unpivot(events, fields)


def provenance_counts(fields: DataFrame) -> DataFrame:
    return fields.groupBy("session_id").agg(*(F.count_if(F.col("provenance") == p).alias(p) for p in ("proof", "claim", "neutral")))


def cross_check(claims: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(session_id, pos, predicate, verdict) for claims (session_id, pos, text) against tool outcomes (session_id, tool, is_error): verified if any tool of the predicate succeeded, contradicted if one ran
    but none did, else unverifiable. Outcomes are first reduced to one row for each session and predicate."""
    spark = claims.sparkSession
    phrases = spark.createDataFrame([(p, x) for p, phrases, _ in PREDICATES for x in phrases], "predicate string, phrase string")
    hints = spark.createDataFrame([(p, h) for p, _, hints in PREDICATES for h in hints], "predicate string, hint string")
    said = claims.join(F.broadcast(phrases), F.lower("text").contains(F.col("phrase"))).select("session_id", "pos", "predicate").distinct()
    proved = outcomes.join(F.broadcast(hints), F.lower("tool").contains(F.col("hint"))).groupBy("session_id", "predicate").agg(F.max((F.col("is_error") == 0).cast("int")).alias("good"))
    verdict = F.when(F.col("good") == 1, "verified").when(F.col("good") == 0, "contradicted").otherwise("unverifiable")
    return said.join(proved, ["session_id", "predicate"], "left").select("session_id", "pos", "predicate", verdict.alias("verdict"))


def claim_integrity(checked: DataFrame) -> DataFrame:
    """(session_id, verified, contradicted, unverifiable, integrity): integrity is null where nothing was decided."""
    df = checked.groupBy("session_id").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("verified", "contradicted", "unverifiable")))
    decided = F.col("verified") + F.col("contradicted")
    return df.withColumn("integrity", F.when(decided > 0, F.round(F.col("verified") / decided, 6)))


def is_error_result(output: str | Column) -> Column:
    """A tool's result (JSON text) says that it is an error, or has an exit code other than 0; anything that is no object is none."""
    r = F.from_json(F.col(output) if isinstance(output, str) else output, "is_error STRING, exit_code STRING")
    return F.coalesce(r["is_error"] == "true", F.lit(False)) | F.coalesce(r["exit_code"].try_cast("double") != 0, F.lit(False))


def proof_text(output: str | Column) -> Column:
    """The texts of a tool's result, in lower case."""
    r = F.from_json(F.col(output) if isinstance(output, str) else output, ", ".join(f"{k} STRING" for k in RESULT_TEXTS))
    return F.lower(F.concat_ws("\n", *(r[k] for k in RESULT_TEXTS)))


def proof_index(events: DataFrame) -> DataFrame:
    """(session_id, pos, tool, is_error, text) of events (session_id, pos, tool_name, tool_output) that have a result."""
    return events.where("tool_output is not null").select("session_id", "pos", F.coalesce(F.nullif("tool_name", F.lit("")), F.lit("<unknown>")).alias("tool"), is_error_result("tool_output").alias("is_error"), proof_text("tool_output").alias("text"))


def _holds(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def _predicates(rule) -> Column:
    """The predicates for which rule(name, phrases, hints) holds."""
    return F.array_compact(F.array(*(F.when(rule(*p), F.lit(p[0])) for p in PREDICATES)))


def check_trace(events: DataFrame) -> DataFrame:
    """(session_id, pos, source, predicate, verdict, proof_pos) of all that a model claims in events (session_id, pos, type, tool_name, tool_output, output_data, reasoning).

    A tool call is proved by its own result; without one it is unverifiable, an instrumentation gap. What is narrated or reasoned is checked by predicate: verified by the first success that bears on it, contradicted by the last error if there is none,
    else unverifiable, as is text that claims nothing that can be checked. Results are first reduced to one row for each session and predicate.
    """
    proofs = proof_index(events)
    called = events.where("tool_name is not null").withColumn("failed", F.when(F.col("tool_output").isNotNull(), is_error_result("tool_output")))
    own = F.when(F.col("failed").isNull(), "unverifiable").when(F.col("failed"), "contradicted").otherwise("verified")
    name = F.coalesce(F.nullif("tool_name", F.lit("")), F.lit("<unknown>"))
    invoked = called.select("session_id", "pos", F.lit("tool_invocation").alias("source"), F.concat(F.lit("tool:"), name).alias("predicate"), own.alias("verdict"), F.when(F.col("failed").isNotNull(), F.col("pos")).alias("proof_pos"))
    bears = _predicates(lambda p, phrases, hints: _holds(F.lower("tool"), hints) | _holds(F.col("text"), PROOF_WORDS.get(p, [])))
    good = ~F.col("is_error")
    proved = proofs.select("session_id", "pos", "is_error", F.explode(bears).alias("predicate")).groupBy("session_id", "predicate").agg(F.min(F.when(good, F.col("pos"))).alias("success"), F.max(F.when(~good, F.col("pos"))).alias("failure"))
    said = F.array(F.struct(F.lit("narration").alias("source"), F.when(~F.col("type").isin(TOOL_EVENTS), F.col("output_data")).alias("text")), F.struct(F.lit("reasoning").alias("source"), F.col("reasoning").alias("text")))
    texts = events.select("session_id", "pos", F.explode(said).alias("s")).select("session_id", "pos", "s.*").where("text is not null")
    claimed = _predicates(lambda p, phrases, hints: _holds(F.lower("text"), phrases))
    each = texts.select("session_id", "pos", "source", F.explode(F.when(F.size(claimed) > 0, claimed).otherwise(F.array(F.lit("narrative")))).alias("predicate"))
    verdict = F.when(F.col("success").isNotNull(), "verified").when(F.col("failure").isNotNull(), "contradicted").otherwise("unverifiable")
    checked = each.join(proved, ["session_id", "predicate"], "left").select("session_id", "pos", "source", "predicate", verdict.alias("verdict"), F.coalesce("success", "failure").alias("proof_pos"))
    return invoked.unionByName(checked)


def instrumentation_gaps(checked: DataFrame, most: int = 0) -> DataFrame:
    """(session_id, gaps, within): claims that nothing recorded bears on, and whether there are at most `most`."""
    return checked.groupBy("session_id").agg(F.count_if(F.col("verdict") == "unverifiable").alias("gaps")).withColumn("within", F.col("gaps") <= most)
