"""Registered queries and their oracles, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import store_queries
from tracewell.functions import assertions as A
from tracewell.functions import repetition
from tracewell.functions import sql as S
from tracewell.functions import text as T
from tracewell.operators import claims, fleet, judge, projection, sessions, similar, traces
from tracewell.operators.sessions import WEEKLY
from tracewell.plans.scratch import materialise
from tracewell.plans.views import run_events, table
from tracewell.rule_queries import REGISTRY as RULE_QUERIES
from tracewell.sources import built, exports
from tracewell.streaming import guard as guards
from tracewell.text_queries import REGISTRY as TEXT_QUERIES
from tracewell.text_queries import _claims_sql
from tracewell.text_queries import pairs as _pairs

Query = Callable[[SparkSession, str], DataFrame]


def _events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(run_events(table(spark, sf_dir, "events")))


def _scores(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _events(lambda e: f(fleet.check_scores(e, WEEKLY)))


def _stored_scores(f: Callable[[DataFrame], DataFrame]) -> Query:
    """For queries that use the scores several times: events are scored once, and the small table of scores is written and read back."""
    return _scores(lambda c: f(materialise(c, "scores")))


def _docs(f: Callable[[DataFrame], DataFrame], name: str = "documents") -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


# ---- SQL shared by the oracles -------------------------------------------------

_RE = """WITH re0 AS (
  SELECT user_id || '-' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS session_id, 'w' || (user_id % 10) AS worker, 'm' || (user_id % 4) AS model, event_id,
    epoch_us(ts) // 1000 AS ts_ms, CASE event_type WHEN 'view' THEN 'output' WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'heartbeat' WHEN 'purchase' THEN 'end' ELSE 'output' END AS type,
    CAST(floor(value * 1000) AS BIGINT) AS tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS tool, event_type || '(' || props || ')' AS tool_sig FROM events),
re AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS pos FROM re0),
g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY pos) AS gap FROM re),
hb AS (SELECT session_id, max(len) AS longest FROM (SELECT session_id, count(*) AS len FROM (SELECT *, pos - row_number() OVER (PARTITION BY session_id, type ORDER BY pos) AS grp FROM re) WHERE type = 'heartbeat' GROUP BY session_id, grp) GROUP BY session_id),
s0 AS (SELECT session_id, min(worker) AS worker, min(model) AS model, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n_events, count(*) FILTER (type = 'error') AS n_errors,
    count(*) FILTER (type IN ('output', 'tool_call', 'tool_result')) AS n_outputs, CAST(sum(tokens) AS BIGINT) AS tokens, arg_max(type, pos) AS last_type, max(CASE WHEN type = 'end' THEN 1 ELSE 0 END) AS has_end FROM re GROUP BY session_id),
s AS (SELECT *, last_ms - first_ms AS runtime_ms, CASE WHEN last_type = 'end' AND n_errors = 0 THEN 1 ELSE 0 END AS clean FROM s0),
issues AS (SELECT session_id, 'stale_gap' AS kind, 'warning' AS severity, count(*) AS n FROM g WHERE gap > 172800000 GROUP BY session_id
  UNION ALL SELECT session_id, 'no_output', 'error', 1 FROM s WHERE n_events < 2
  UNION ALL SELECT session_id, 'no_end', 'warning', 1 FROM s WHERE has_end = 0
  UNION ALL SELECT session_id, 'no_progress', 'error', 1 FROM s WHERE n_outputs = 0
  UNION ALL SELECT session_id, 'no_progress', 'warning', 1 FROM hb WHERE longest > 5
  UNION ALL SELECT session_id, 'timeout', 'error', 1 FROM s WHERE runtime_ms > 518400000),
per AS (SELECT session_id, CAST(sum(n) AS BIGINT) AS n_issues, CAST(sum(CASE WHEN severity = 'error' THEN n ELSE 0 END) AS BIGINT) AS e, CAST(sum(CASE WHEN severity = 'warning' THEN n ELSE 0 END) AS BIGINT) AS w,
    max(CASE WHEN kind = 'timeout' THEN 1 ELSE 0 END) AS timed_out, max(CASE WHEN kind IN ('stale_gap', 'no_progress') THEN 1 ELSE 0 END) AS stalled FROM issues GROUP BY session_id),
calls AS (SELECT session_id, tool_sig, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS pos FROM re WHERE type = 'tool_call'),
sigs AS (SELECT session_id, tool_sig, count(*) AS n, min(pos) AS first FROM calls GROUP BY ALL),
tops AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY session_id) AS n_calls FROM sigs),
streaks AS (SELECT session_id, max(len) AS streak FROM (SELECT session_id, count(*) AS len FROM (SELECT *, pos - row_number() OVER (PARTITION BY session_id, tool_sig ORDER BY pos) AS grp FROM calls) GROUP BY session_id, tool_sig, grp) GROUP BY session_id),
loops AS (SELECT session_id, CAST(n_calls AS BIGINT) AS n_calls, tool_sig AS top_sig, n AS top_count, round(n / CAST(n_calls AS DOUBLE), 6) AS share, streak FROM tops JOIN streaks USING (session_id) WHERE rn = 1),
tri0 AS (SELECT s.*, coalesce(n_issues, 0) AS n_issues, coalesce(e, 0) AS e, coalesce(timed_out, 0) AS timed_out, coalesce(stalled, 0) AS stalled,
    CASE WHEN n_calls >= 4 THEN greatest(share, round(streak / CAST(n_calls AS DOUBLE), 6)) ELSE 0 END AS loop FROM s LEFT JOIN per USING (session_id) LEFT JOIN loops USING (session_id)),
kinds AS (SELECT session_id, string_agg(kind, ',' ORDER BY list_position(['timeout', 'no_output', 'stale_gap', 'no_end', 'no_progress'], kind)) AS kinds FROM (SELECT DISTINCT session_id, kind FROM issues) GROUP BY session_id),
tri AS (SELECT session_id, CASE WHEN clean = 1 THEN CASE WHEN tokens >= 1000000 THEN 'over-cost' WHEN runtime_ms >= 518400000 THEN 'over-latency' WHEN n_events >= 400 THEN 'excessive-steps' WHEN loop >= 0.5 THEN 'loop-without-progress' END
    WHEN e > 0 OR n_issues >= 3 THEN CASE WHEN timed_out = 1 THEN 'timeout' WHEN has_end = 0 AND n_errors = 0 THEN 'abandoned' WHEN tokens >= 1000000 THEN 'runaway' WHEN stalled = 1 THEN 'stalled' ELSE 'errored' END END AS kind,
    tokens, runtime_ms, CASE WHEN tokens >= 200000 OR runtime_ms >= 432000000 THEN 1 ELSE 0 END AS costly, round(tokens / 1000000.0 * 9, 6) AS projected_usd,
    CASE WHEN clean = 1 THEN array_to_string(list_filter([CASE WHEN tokens >= 1000000 THEN 'over-cost' END, CASE WHEN runtime_ms >= 518400000 THEN 'over-latency' END, CASE WHEN n_events >= 400 THEN 'excessive-steps' END, CASE WHEN loop >= 0.5 THEN 'loop-without-progress' END], lambda x: x IS NOT NULL), ',') ELSE coalesce(kinds, '') END AS issue_kinds
    FROM tri0 LEFT JOIN kinds USING (session_id)),
triage AS (SELECT * FROM tri WHERE kind IS NOT NULL),
oc AS (SELECT session_id, model, tool, CASE WHEN type = 'error' THEN 1 ELSE 0 END AS is_error, tokens, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS pos FROM re WHERE type IN ('tool_call', 'error')),
runs AS (SELECT session_id, count(*) AS len, arg_min(is_error, pos) AS head FROM (SELECT *, pos - row_number() OVER (PARTITION BY session_id, tool ORDER BY pos) AS grp FROM oc) GROUP BY session_id, tool, grp),
retry AS (SELECT session_id, max(CASE WHEN len >= 2 AND head = 1 THEN len ELSE 0 END) AS longest_streak, CAST(sum(CASE WHEN len >= 2 AND head = 1 THEN len - 1 ELSE 0 END) AS BIGINT) AS retry_count FROM runs GROUP BY session_id),
later AS (SELECT *, max(1 - is_error) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_success FROM oc),
rec0 AS (SELECT session_id, count(*) FILTER (is_error = 1 AND later_success = 1) AS recovered, count(*) FILTER (is_error = 1 AND later_success = 0) AS unrecovered FROM later GROUP BY session_id),
rec AS (SELECT *, CASE WHEN recovered + unrecovered = 0 THEN 1.0 ELSE round(recovered / CAST(recovered + unrecovered AS DOUBLE), 6) END AS recovery_rate FROM rec0),
fp AS (SELECT session_id, min(model) AS model, count(*) AS tool_calls, CAST(sum(is_error) AS BIGINT) AS tool_errors, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(is_error) / CAST(count(*) AS DOUBLE), 6) AS error_rate FROM oc GROUP BY session_id),
foot AS (SELECT * FROM fp JOIN retry USING (session_id) JOIN rec USING (session_id)),
cand0 AS (SELECT model, count(*) AS runs, avg(tool_calls) AS steps, avg(error_rate) AS er, avg(recovery_rate) AS rr, avg(longest_streak) AS th, avg(tokens) AS cost, min(CASE WHEN error_rate <= 0.5 AND longest_streak <= 2 THEN 1 ELSE 0 END) AS clean_run FROM foot GROUP BY model),
cand AS (SELECT model, runs, floor((2.0 + greatest(0, least(1, 1 - er)) + greatest(0, least(1, rr)) + greatest(0, least(1, 1 - th / 5)) + CASE WHEN max(steps) OVER () <= 0 THEN 1 ELSE 1 - steps / max(steps) OVER () END
    + 0.5 * CASE WHEN max(cost) OVER () <= 0 THEN 1 ELSE 1 - cost / max(cost) OVER () END) / 6.5 * 1000 + 0.5) / 1000 AS score, clean_run FROM cand0),
ranked AS (SELECT *, rank() OVER (ORDER BY score DESC, clean_run DESC) AS rank FROM cand),
sc0 AS (SELECT s.*, coalesce(e, 0) AS e, coalesce(w, 0) AS w FROM s LEFT JOIN per USING (session_id)),
sc AS (SELECT worker, session_id AS run_id, first_ms AS started_ms, 'staleness' AS "check", round(greatest(0.0, least(1.0, 1 - 0.5 * e - 0.15 * w)), 6) AS score, CASE WHEN e > 0 OR e + w >= 3 THEN 'fail' WHEN w > 0 THEN 'warn' ELSE 'pass' END AS status FROM sc0
  UNION ALL SELECT worker, session_id, first_ms, 'verification', round(1 - 0.6 * least(n_errors, 1), 6), CASE WHEN n_errors > 0 THEN 'fail' ELSE 'pass' END FROM sc0
  UNION ALL SELECT worker, session_id, first_ms, 'completeness', round(1 - 0.4 * CAST(n_outputs = 0 AS INT) - 0.1 * CAST(has_end = 0 AS INT), 6), CASE WHEN n_outputs = 0 THEN 'fail' WHEN has_end = 0 THEN 'warn' ELSE 'pass' END FROM sc0),
rs AS (SELECT worker, run_id, avg(score) AS overall, min(score) AS worst, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'warn') AS warns, count(*) AS scored FROM sc GROUP BY worker, run_id),
tr0 AS (SELECT *, row_number() OVER (PARTITION BY worker, "check" ORDER BY started_ms, run_id) AS rn, count(*) OVER (PARTITION BY worker, "check") AS n FROM sc),
tr1 AS (SELECT *, rn > n - greatest(1, least(n - 1, n // 2)) AS recent FROM tr0),
tr2 AS (SELECT worker, "check", count(*) FILTER (NOT recent) AS n_base, count(*) FILTER (recent) AS n_recent, avg(score) FILTER (NOT recent) AS mean_base, avg(score) FILTER (recent) AS mean_recent, stddev_pop(score) FILTER (NOT recent) AS sd_base FROM tr1 GROUP BY worker, "check"),
tr3 AS (SELECT *, mean_recent - mean_base AS delta FROM tr2),
tr4 AS (SELECT *, CASE WHEN sd_base = 0 THEN CASE WHEN delta = 0 THEN 0.0 ELSE sign(delta) * 99.0 END ELSE greatest(-99.0, least(99.0, delta / sd_base)) END AS z FROM tr3),
tr5 AS (SELECT *, CASE WHEN n_base < 2 OR n_recent < 2 THEN 'insufficient-data' WHEN abs(z) < 1 OR abs(delta) < 0.05 THEN 'stable' WHEN delta < 0 THEN 'degrading' ELSE 'improving' END AS direction FROM tr4),
tr AS (SELECT *, CASE WHEN direction <> 'degrading' THEN 'none' WHEN abs(z) >= 2.5 THEN 'critical' ELSE 'warning' END AS severity FROM tr5),
wt0 AS (SELECT worker, count(*) FILTER (direction = 'degrading') AS degrading, count(*) FILTER (direction = 'improving') AS improving, max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS critical FROM tr GROUP BY worker),
wt AS (SELECT *, CASE WHEN degrading > improving THEN 'degrading' WHEN degrading < improving THEN 'improving' ELSE 'stable' END AS net FROM wt0),
card0 AS (SELECT worker, count(*) AS runs, round(avg(CASE WHEN fails = 0 THEN 1 ELSE 0 END), 6) AS pass_rate, round(avg(overall), 6) AS mean_score FROM rs GROUP BY worker),
card1 AS (SELECT card0.*, coalesce(net, 'stable') AS trend, critical, CASE WHEN pass_rate >= 0.9 THEN 'healthy' WHEN pass_rate >= 0.6 THEN 'watch' ELSE 'at-risk' END AS base FROM card0 LEFT JOIN wt USING (worker)),
card AS (SELECT worker, runs, pass_rate, mean_score, trend, CASE WHEN trend = 'degrading' AND critical = 1 THEN CASE WHEN base = 'at-risk' THEN 'critical' ELSE 'at-risk' END WHEN trend = 'degrading' AND base = 'healthy' THEN 'watch' ELSE base END AS grade FROM card1)
"""

_W = r"regexp_extract_all({x}, '[^ \t\n\r\f\x0B]+')"


def _words(x: str) -> str:
    return _W.replace("{x}", x)


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '')"
_FIRST = "SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS task, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id"


def _ngram_saturation(d: DataFrame) -> DataFrame:
    """Share of the five most frequent word trigrams. Only texts are shuffled, to bring those of one document together; trigrams are counted text by text where they are."""
    texts = d.select("doc_id", T.ngram_text(F.col("text")).alias("text")).repartition("doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    counts = texts.select("doc_id", repetition.gram_counts("texts").alias("n")).where("n.total > 0")
    return counts.select("doc_id", F.round(F.col("n.most") / F.col("n.total"), 6).alias("score"), F.col("n.unique").alias("unique_grams"), F.col("n.total").alias("total_grams"))


def _upserted(o: DataFrame) -> DataFrame:
    return fleet.upsert_latest(o.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


def _as_spans(e: DataFrame) -> DataFrame:
    """Run events as OTLP exports, a span each: errors failed, calls with a tool's name and arguments, all with tokens."""
    value = lambda text=None, number=None: F.struct((F.lit(None) if text is None else text).cast("string").alias("stringValue"), (F.lit(None) if number is None else number).cast("string").alias("intValue"), *(F.lit(None).cast(t).alias(n) for n, t in (("doubleValue", "double"), ("boolValue", "boolean"), ("arrayValue", "struct<values:array<struct<stringValue:string>>>"))))
    pair = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
    called = F.col("type") == "tool_call"
    own = [pair("gen_ai.conversation.id", value(F.col("session_id"))), pair("gen_ai.usage.output_tokens", value(number=F.col("tokens")))]
    more = [pair("gen_ai.operation.name", value(F.lit("execute_tool"))), pair("gen_ai.tool.name", value(F.lit("click"))), pair("gen_ai.tool.call.arguments", value(F.regexp_extract("tool_sig", "\\((.*)\\)$", 1)))]
    attributes = F.when(called, F.array(*own, *more)).otherwise(F.array(*own))
    nanos = F.concat(F.col("ts_ms").cast("string"), F.lit("000000"))
    span = F.struct(
        F.col("session_id").alias("traceId"), F.concat_ws("/", "session_id", "pos").alias("spanId"), F.col("type").alias("name"), nanos.alias("startTimeUnixNano"), nanos.alias("endTimeUnixNano"), attributes.alias("attributes"),
        F.struct(F.when(F.col("type") == "error", "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK").alias("code"), F.lit(None).cast("string").alias("message")).alias("status"),
    )
    return e.select(F.from_json(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))), exports.OTLP)["resourceSpans"].alias("resourceSpans"))


def _as_runs(e: DataFrame) -> DataFrame:
    """Run events as run exports, a text a session in one of four forms: an array, an object with runs, an object of runs by keys, and a run a line."""
    at, utc = F.timestamp_millis("ts_ms"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "timeZone": "UTC"}
    called = F.col("type") == "tool_call"
    run = F.struct(
        F.concat_ws("/", "session_id", "pos").alias("id"), F.col("session_id").alias("trace_id"), F.when(F.col("pos") > 1, F.concat_ws("/", "session_id", F.lit("1"))).alias("parent_run_id"), F.when(called, "click").otherwise(F.col("type")).alias("name"),
        F.when(called, "tool").when(F.col("type") == "output", "llm").otherwise("chain").alias("run_type"), at.alias("start_time"), at.alias("end_time"), F.when(F.col("type") == "error", "it broke").alias("error"),
        F.when(~called, F.col("tokens")).alias("total_tokens"), F.when(called, F.parse_json(F.regexp_extract("tool_sig", "\\((.*)\\)$", 1))).alias("inputs"),
    )
    runs = e.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.to_json(run, utc).alias("run")))).alias("runs"), F.max("pos").alias("n")).withColumn("runs", F.transform("runs", lambda r: r["run"]))
    array, form = F.concat(F.lit("["), F.array_join("runs", ","), F.lit("]")), F.pmod(F.crc32(F.col("session_id").cast("binary")), F.lit(4))
    named = F.concat(F.lit("{"), F.array_join(F.transform("runs", lambda r, i: F.concat(F.lit('"r'), i.cast("string"), F.lit('": '), r)), ","), F.lit("}"))
    return runs.select(F.when(form == 0, array).when(form == 1, F.concat(F.lit('{"runs": '), array, F.lit("}"))).when(form == 2, named).otherwise(F.array_join("runs", "\n")).alias("value"))


def _triage_built_sql(tokens: str) -> str:
    """Triage of built sessions: what their events tell by themselves, with a start and an end more."""
    return f""", o AS (SELECT s.session_id, {tokens} AS tokens, runtime_ms, n_errors, n_events + 2 AS steps, CASE WHEN n_calls >= 4 THEN greatest(share, round(streak / CAST(n_calls AS DOUBLE), 6)) ELSE 0 END AS loop, s.n_events - n_errors AS good, runtime_ms > 518400000 AS late, (SELECT count(*) FROM g WHERE g.session_id = s.session_id AND gap > 172800000) AS gaps FROM s LEFT JOIN loops USING (session_id) JOIN mt USING (session_id)),
k AS (SELECT *, CASE WHEN n_errors = 0 THEN [CASE WHEN tokens >= 1000000 THEN 'over-cost' END, CASE WHEN runtime_ms >= 518400000 THEN 'over-latency' END, CASE WHEN steps >= 400 THEN 'excessive-steps' END, CASE WHEN loop >= 0.5 THEN 'loop-without-progress' END]
  ELSE [CASE WHEN late THEN 'timeout' END, CASE WHEN gaps > 0 THEN 'stale_gap' END, CASE WHEN good = 0 THEN 'no_progress' END] END AS kinds FROM o)
SELECT session_id, CASE WHEN n_errors = 0 THEN list_filter(kinds, lambda x: x IS NOT NULL)[1] WHEN late THEN 'timeout' ELSE 'abandoned' END AS kind, tokens, runtime_ms, CASE WHEN tokens >= 200000 OR runtime_ms >= 432000000 THEN 1 ELSE 0 END AS costly, round(tokens / 1000000.0 * 9, 6) AS projected_usd, array_to_string(list_filter(kinds, lambda x: x IS NOT NULL), ',') AS issue_kinds
FROM k WHERE CASE WHEN n_errors = 0 THEN len(list_filter(kinds, lambda x: x IS NOT NULL)) > 0 ELSE late OR good = 0 OR gaps >= 3 END"""


def _cost_ceiling(e: DataFrame, cap: float = 5.0) -> DataFrame:
    """Sessions of each worker, oldest first, as long as their running cost stays within the cap. Sums run inside a worker's day; the days before it add theirs, so that no task holds a worker."""
    df = sessions.sessions(e).select("worker", "session_id", "first_ms", "tokens", F.floor(F.col("first_ms") / fleet.DAY_MS).alias("day"))
    inside = F.sum("tokens").over(Window.partitionBy("worker", "day").orderBy("first_ms", "session_id").rowsBetween(Window.unboundedPreceding, 0))
    days = df.groupBy("worker", "day").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("worker").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("inside", inside).join(days.select("worker", "day", before.alias("before")), ["worker", "day"]).withColumn("running_tokens", F.col("before") + F.col("inside"))
    return df.where(F.col("running_tokens") * 0.59 / 1_000_000 <= cap).select("worker", "session_id", "running_tokens")


#: The guard's budgets for sessions of a week. The loop test has no SQL and is off.
_WATCH = guards.GuardLimits(max_tokens=300_000, max_ms=518_400_000, max_gap_ms=172_800_000, loop_window=0)


def _guarded(e: DataFrame) -> DataFrame:
    """What the live guard would have said of the sessions, with tokens summed up as they come."""
    running = F.sum("tokens").over(Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return guards.replay(e.select("session_id", "pos", "ts_ms", "type", F.col("tool_sig").alias("content"), running.alias("tokens")), _WATCH, ("pos",))


def _sql_metrics(d: DataFrame) -> DataFrame:
    """Text metrics by name out of SQL, generators in lateral views."""
    S.register(d.sparkSession)
    counted = "(SELECT doc_id, count(*) AS n FROM {d} LATERAL VIEW explode(%s(text)) v AS c GROUP BY doc_id)"
    return d.sparkSession.sql(
        "SELECT d.doc_id, tw_tokens(text) AS tokens, tw_word_count(text) AS n_words, tw_slug(source) AS slug, tw_jaccard(text, 'the version of the text is licensed') AS jaccard, tw_keyword_coverage(text, array('licensed', 'reserved', 'version', 'the')) AS coverage, tw_duration(n_chars * 37.0D) AS duration, "
        f"coalesce(c.n, 0) AS claims FROM {{d}} d LEFT JOIN {counted % 'tw_claims'} c ON d.doc_id = c.doc_id",
        d=d,
    )


def _judge_inputs(c: DataFrame) -> DataFrame:
    """What a judge of 600 tokens gets to see of conversations: the last answer, the first question, and all that each side said."""
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"]), "\n")
    ends = [F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("output"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("task")]
    df = c.where("text is not null").groupBy("conv_id").agg(*ends, said("assistant").alias("x"), said("user").alias("y"))
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("text")) for n in "xy"))
    shown = projection.token_capped(df.select("conv_id", "output", "task", named.alias("artifacts")), 600)
    return shown.select("conv_id", "input_tokens", F.col("truncated").cast("int").alias("truncated"), *(F.length(c).alias(f"n_{c}") for c in ("output", "task")), *(F.length(F.get("artifacts", F.lit(i))["text"]).alias(f"n_{n}") for i, n in enumerate("xy")))


_TOK = "CAST(ceil(length({x}) / 4.0) AS BIGINT)"
_CUT = "CASE WHEN " + _TOK + " <= {m} THEN {x} ELSE left({x}, CAST(floor({m} * 4 * 0.6) AS BIGINT)) || chr(10) || '...[truncated ' || (" + _TOK + " - {m}) || ' tokens]...' || chr(10) || right({x}, CAST({m} * 4 - floor({m} * 4 * 0.6) AS BIGINT)) END"
_TOTAL = f"{_TOK.format(x='output')} + {_TOK.format(x='task')} + {_TOK.format(x='x')} + {_TOK.format(x='y')} - 600"
_TRIM = f"SELECT * REPLACE (CASE WHEN over > 0 AND tx >= ty THEN left(x, greatest(0, length(x) - over * 4 - 8)) ELSE x END AS x, CASE WHEN over > 0 AND tx < ty THEN left(y, greatest(0, length(y) - over * 4 - 8)) ELSE y END AS y) FROM (SELECT * EXCLUDE (over, tx, ty), {_TOTAL} AS over, {_TOK.format(x='x')} AS tx, {_TOK.format(x='y')} AS ty FROM %s)"
_JUDGE_INPUTS = f"""WITH c AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS o, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS t, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'assistant'), '') AS a, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'user'), '') AS b FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
d AS (SELECT *, {_CUT.format(x='o', m='240')} AS output, {_CUT.format(x='t', m='60')} AS task FROM c),
e AS (SELECT *, greatest(200, CAST(floor((600 - {_TOK.format(x='output')} - {_TOK.format(x='task')}) / 2) AS BIGINT)) AS share FROM d),
f AS (SELECT conv_id, o, t, a, b, output, task, {_CUT.format(x='a', m='share')} AS x, {_CUT.format(x='b', m='share')} AS y, 0 AS over, 0 AS tx, 0 AS ty FROM e),
g AS ({_TRIM % 'f'}), h AS ({_TRIM % 'g'})
SELECT conv_id, {_TOTAL} + 600 AS input_tokens, CAST(output <> o OR task <> t OR x <> a OR y <> b AS INT) AS truncated, length(output) AS n_output, length(task) AS n_task, length(x) AS n_x, length(y) AS n_y FROM h"""


_SAID, _RAN = ["tests pass", "build passed", "pushed it", "score was 9", "looked around"], ["run_test", "build", "git_push", "score_run", "other"]


def _selection(e: DataFrame) -> DataFrame:
    """Models of each worker ranked, with what outputs claim (a phrase for each, by their tokens) checked against calls (tools with names)."""
    named = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    said = e.where("type = 'output'").select("session_id", "pos", named(_SAID, F.col("tokens") % 5).alias("text"))
    ran = traces.tool_outcomes(e).select("session_id", named(_RAN, F.col("tool")).alias("tool"), "is_error")
    runs = traces.runs_with_claims(traces.footprint(e), claims.claim_integrity(claims.cross_check(said, ran)))
    workers = e.groupBy("session_id").agg(F.min("worker").alias("worker"))
    return traces.rank_selection(runs.join(workers, "session_id"), "model", ["worker"])


_CLAIMED = """, said AS (SELECT DISTINCT session_id, pos, CASE tokens % 5 WHEN 0 THEN 'tests:pass' WHEN 1 THEN 'build:pass' WHEN 2 THEN 'push' ELSE 'score:green' END AS predicate FROM re WHERE type = 'output' AND tokens % 5 < 4),
proved AS (SELECT session_id, CASE tool WHEN 0 THEN 'tests:pass' WHEN 1 THEN 'build:pass' WHEN 2 THEN 'push' ELSE 'score:green' END AS predicate, max(1 - is_error) AS good FROM oc WHERE tool < 4 GROUP BY ALL),
int0 AS (SELECT session_id, count(*) FILTER (good = 1) AS v, count(*) FILTER (good = 0) AS c FROM said LEFT JOIN proved USING (session_id, predicate) GROUP BY session_id),
cr AS (SELECT w.worker, foot.*, coalesce(c, 0) AS c, CASE WHEN v + c > 0 THEN round(v / CAST(v + c AS DOUBLE), 6) END AS integ FROM foot JOIN (SELECT session_id, min(worker) AS worker FROM re GROUP BY session_id) w USING (session_id) LEFT JOIN int0 USING (session_id)),
ca AS (SELECT worker, model, count(*) AS runs, avg(tool_calls) AS steps, avg(error_rate) AS er, avg(recovery_rate) AS rr, avg(longest_streak) AS th, avg(tokens) AS cost, avg(integ) AS integ, CAST(sum(c) AS BIGINT) AS contradictions, min(CASE WHEN error_rate <= 0.5 AND longest_streak <= 2 AND c = 0 THEN 1 ELSE 0 END) AS clean_run FROM cr GROUP BY worker, model),
cs0 AS (SELECT *, round(greatest(0, least(1, (coalesce(2.0 * integ, 0) + CASE WHEN contradictions = 0 THEN 2.0 ELSE 0 END + greatest(0, least(1, 1 - er)) + greatest(0, least(1, rr)) + greatest(0, least(1, 1 - th / 5)) + CASE WHEN max(steps) OVER w <= 0 THEN 1 ELSE 1 - steps / max(steps) OVER w END
  + 0.5 * CASE WHEN max(cost) OVER w <= 0 THEN 1 ELSE 1 - cost / max(cost) OVER w END) / (6.5 + CASE WHEN integ IS NULL THEN 0 ELSE 2 END))), 12) AS whole FROM ca WINDOW w AS (PARTITION BY worker)),
cs AS (SELECT *, floor(whole * 1000 + 0.5) / 1000 AS score FROM cs0),
crank AS (SELECT worker, model, runs, score, contradictions, round(integ, 6) AS integrity, clean_run, rank() OVER (PARTITION BY worker ORDER BY whole DESC, contradictions, coalesce(integ, -1) DESC, er, steps, cost) AS rank FROM cs)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(criterion, expected, actual): labels against a rule-based judge of five levels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")
    actual = F.when(d["text"].contains("$$$") | d["text"].contains("!!"), 1).when(F.length(d["text"]) < 400, 3).when(F.length(d["text"]) < 800, 4).otherwise(5)
    return d.select(F.col("lang").alias("criterion"), F.when(F.col("quality") == 1, 5).otherwise(1).alias("expected"), actual.alias("actual"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _judged(spark, sf_dir)
    return judge.verdicts(d.select(F.col("criterion").alias("item"), ((F.col("actual") - 1) / 4).alias("score"), F.col("expected").alias("weight"), F.when(F.col("actual") == 3, 0.5).otherwise(0.9).alias("confidence")))


def _asserted(d: DataFrame) -> DataFrame:
    t = F.col("text")
    return A.assert_all(d, "doc_id", {"contains": A.contains(t, "the"), "contains_any_case": A.contains(t, "LICENSED UNDER", True), "prefix": t.startswith("The"), "suffix": t.endswith("."), "match": A.matches(t, "[0-9]{16}"), "length": A.length_between(t, 100, 2000)})


_JUDGED = "WITH j AS (SELECT lang AS criterion, CASE WHEN quality = 1 THEN 5 ELSE 1 END AS expected, CASE WHEN contains(text, '$$$') OR contains(text, '!!') THEN 1 WHEN length(text) < 400 THEN 3 WHEN length(text) < 800 THEN 4 ELSE 5 END AS actual FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)\n"
_RATES = "count(*) AS n, round(avg(CAST(actual = expected AS INT)), 6) AS exact, round(avg(CAST(abs(actual - expected) <= 1 AS INT)), 6) AS within_one, round(avg(actual - expected), 6) AS bias"
_KEYWORDS = ["licensed", "reserved", "version", "the"]
_ASSERTED = "SELECT doc_id, unnest(['contains', 'contains_any_case', 'prefix', 'suffix', 'match', 'length']) AS assertion, unnest(list_transform([contains(text, 'the'), contains(lower(text), 'licensed under'), starts_with(text, 'The'), ends_with(text, '.'), regexp_matches(text, '[0-9]{16}'), length(text) BETWEEN 100 AND 2000], lambda b: CASE WHEN b THEN 'pass' ELSE 'fail' END)) AS status FROM documents"
_SEL = ["session_id", "worker", "model", "first_ms", "last_ms", "n_events", "n_errors", "n_outputs", "tokens", "last_type", "has_end", "runtime_ms", "clean"]

#: Name -> (query, SQL for DuckDB).
REGISTRY: dict[str, tuple[Query, str | None]] = {
    "triage_rows": (_events(lambda e: sessions.triage(e, WEEKLY)), _RE + "SELECT * FROM triage"),
    "triage_otlp": (
        _events(lambda e: built.triage(built.otlp(_as_spans(e)), WEEKLY)),
        _RE + """, o AS (SELECT s.session_id, tokens, runtime_ms, n_errors, n_events + 2 AS steps, CASE WHEN n_calls >= 4 THEN greatest(share, round(streak / CAST(n_calls AS DOUBLE), 6)) ELSE 0 END AS loop, s.n_events - n_errors AS good, runtime_ms > 518400000 AS late, (SELECT count(*) FROM g WHERE g.session_id = s.session_id AND gap > 172800000) AS gaps FROM s LEFT JOIN loops USING (session_id)),
k AS (SELECT *, CASE WHEN n_errors = 0 THEN [CASE WHEN tokens >= 1000000 THEN 'over-cost' END, CASE WHEN runtime_ms >= 518400000 THEN 'over-latency' END, CASE WHEN steps >= 400 THEN 'excessive-steps' END, CASE WHEN loop >= 0.5 THEN 'loop-without-progress' END]
  ELSE [CASE WHEN late THEN 'timeout' END, CASE WHEN gaps > 0 THEN 'stale_gap' END, CASE WHEN good = 0 THEN 'no_progress' END] END AS kinds FROM o)
SELECT session_id, CASE WHEN n_errors = 0 THEN list_filter(kinds, lambda x: x IS NOT NULL)[1] WHEN late THEN 'timeout' ELSE 'abandoned' END AS kind, tokens, runtime_ms, CASE WHEN tokens >= 200000 OR runtime_ms >= 432000000 THEN 1 ELSE 0 END AS costly, round(tokens / 1000000.0 * 9, 6) AS projected_usd, array_to_string(list_filter(kinds, lambda x: x IS NOT NULL), ',') AS issue_kinds
FROM k WHERE CASE WHEN n_errors = 0 THEN len(list_filter(kinds, lambda x: x IS NOT NULL)) > 0 ELSE late OR good = 0 OR gaps >= 3 END""",
    ),
    "triage_langsmith": (
        _events(lambda e: built.triage(built.langsmith(exports.langsmith_runs(_as_runs(e))), WEEKLY)),
        _RE + ", mt AS (SELECT session_id, CASE WHEN coalesce(sum(tokens) FILTER (type = 'output'), 0) > 0 THEN CAST(sum(tokens) FILTER (type = 'output') AS BIGINT) ELSE coalesce(max(tokens) FILTER (pos = 1 AND type <> 'tool_call'), 0) END AS own FROM re GROUP BY session_id)" + _triage_built_sql("own"),
    ),
    "triage_by_kind": (_events(lambda e: sessions.triage_by_kind(sessions.triage(e, WEEKLY))), _RE + "SELECT kind, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM triage GROUP BY kind"),
    "triage_totals": (_events(lambda e: sessions.triage_totals(sessions.triage(e, WEEKLY))), _RE + "SELECT count(*) AS flagged, count(*) FILTER (costly = 1) AS costly, coalesce(round(sum(projected_usd) FILTER (costly = 1), 4), 0.0) AS projected_usd FROM triage"),
    "triage_topk": (_events(lambda e: sessions.triage_top(sessions.triage(e, WEEKLY))), _RE + "SELECT * FROM triage ORDER BY costly DESC, tokens DESC, runtime_ms DESC, session_id LIMIT 15"),
    "sessions": (_events(lambda e: sessions.sessions(e).select(*_SEL)), _RE + f"SELECT {', '.join(_SEL)} FROM s"),
    "staleness_issues": (_events(lambda e: sessions.issues(e, WEEKLY)), _RE + "SELECT * FROM issues"),
    "stale_sessions": (_events(lambda e: sessions.stale_sessions(e, WEEKLY)), _RE + "SELECT session_id, n_issues, e AS n_errors, CASE WHEN e > 0 OR n_issues >= 3 THEN 1 ELSE 0 END AS stale FROM per"),
    "staleness_gap_lag": (_events(sessions.gaps), _RE + "SELECT session_id, max(gap) AS max_gap_ms, count(gap) AS n_gaps FROM g GROUP BY session_id"),
    "heartbeat_islands": (_events(sessions.heartbeat_runs), _RE + "SELECT * FROM hb"),
    "tool_loops": (_events(sessions.tool_loops), _RE + "SELECT * FROM loops"),
    "footprint": (_events(traces.footprint), _RE + "SELECT * FROM foot"),
    "retry_streak": (_events(lambda e: traces.retries(traces.tool_outcomes(e))), _RE + "SELECT * FROM retry"),
    "recovery_suffix": (_events(lambda e: traces.recovery(traces.tool_outcomes(e))), _RE + "SELECT * FROM rec"),
    "selection_rank": (_events(lambda e: traces.select_candidates(traces.footprint(e))), _RE + "SELECT * FROM ranked"),
    "selection_winner": (_events(lambda e: traces.winner(traces.select_candidates(traces.footprint(e)))), _RE + "SELECT model, score FROM ranked WHERE rank = 1 AND (SELECT count(*) FROM ranked WHERE rank = 1) = 1"),
    "selection_claims": (_events(_selection), _RE + _CLAIMED + "SELECT * FROM crank"),
    "selection_summary": (
        _events(lambda e: traces.ranking_summary(_selection(e), "model", ["worker"])),
        _RE + _CLAIMED + "SELECT worker, CASE WHEN count(*) FILTER (rank = 1) = 1 THEN min(model) FILTER (rank = 1) END AS winner, string_agg(CASE WHEN i = 1 THEN '' WHEN rank = before THEN ' = ' ELSE ' > ' END || model, '' ORDER BY i) AS chain FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY rank, model) AS i, lag(rank) OVER (PARTITION BY worker ORDER BY rank, model) AS before FROM crank) GROUP BY worker",
    ),
    "cost_ceiling_cumsum": (_events(_cost_ceiling), _RE + "SELECT worker, session_id, running_tokens FROM (SELECT worker, session_id, CAST(sum(tokens) OVER (PARTITION BY worker ORDER BY first_ms, session_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens FROM s) WHERE running_tokens * 0.59 / 1000000 <= 5"),
    "check_scores": (_scores(lambda c: c), _RE + "SELECT * FROM sc"),
    "run_scores": (_scores(fleet.run_scores), _RE + "SELECT * REPLACE (round(overall, 6) AS overall) FROM rs"),
    "trend_classify": (_stored_scores(fleet.trends), _RE + "SELECT * REPLACE (round(mean_base, 6) AS mean_base, round(mean_recent, 6) AS mean_recent, round(sd_base, 6) AS sd_base, round(delta, 6) AS delta, round(z, 4) AS z) FROM tr"),
    "trend_fail_rates": (
        _stored_scores(lambda c: fleet.trends(c, "failRate", 0.25).select("worker", "check", "n_base", "n_recent", "mean_base", "mean_recent", "delta")),
        _RE + ", f AS (SELECT worker, \"check\", CASE WHEN status = 'fail' THEN 1.0 ELSE 0.0 END AS v, row_number() OVER (PARTITION BY worker, \"check\" ORDER BY started_ms, run_id) AS rn, count(*) OVER (PARTITION BY worker, \"check\") AS n FROM sc), fr AS (SELECT *, rn > n - greatest(1, least(n - 1, CAST(floor(n * 0.25 + 0.5) AS BIGINT))) AS late FROM f) SELECT worker, \"check\", count(*) FILTER (NOT late) AS n_base, count(*) FILTER (late) AS n_recent, round(avg(v) FILTER (NOT late), 6) AS mean_base, round(avg(v) FILTER (late), 6) AS mean_recent, round(avg(v) FILTER (late) - avg(v) FILTER (NOT late), 6) AS delta FROM fr GROUP BY worker, \"check\"",
    ),
    "trend_worst": (_stored_scores(lambda c: fleet.worst_first(fleet.trends(c), 5).select("worker", "check", "severity", "z")), _RE + "SELECT worker, \"check\", severity, round(z, 4) AS z FROM tr ORDER BY list_position(['none', 'info', 'warning', 'critical'], severity) DESC, abs(round(z, 4)) DESC NULLS LAST, worker, \"check\" LIMIT 5"),
    "rolling_scores": (_scores(fleet.rolling_days), _RE + ", dd AS (SELECT worker, \"check\", started_ms // 86400000 AS day, count(*) AS c, sum(score) AS s FROM sc GROUP BY ALL) SELECT worker, \"check\", day, CAST(sum(c) OVER w AS BIGINT) AS n, round(sum(s) OVER w / sum(c) OVER w, 6) AS mean_score FROM dd WINDOW w AS (PARTITION BY worker, \"check\" ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)"),
    "scores_in_dates": (_scores(lambda c: fleet.in_dates(c, "2024-01-10", "2024-01-20").select("worker", "run_id", "check", "score")), _RE + "SELECT worker, run_id, \"check\", score FROM sc WHERE make_timestamp(started_ms * 1000)::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"),
    "trend_worker_rollup": (_stored_scores(lambda c: fleet.worker_trends(fleet.trends(c))), _RE + "SELECT * FROM wt"),
    "scorecard_workers": (_stored_scores(fleet.scorecard), _RE + "SELECT * FROM card"),
    "scorecard_checks": (_scores(fleet.check_breakdown), _RE + "SELECT worker, \"check\", round(avg(score), 6) AS mean_score, count(*) AS runs, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'warn') AS warns, count(*) FILTER (status = 'pass') AS passes FROM sc GROUP BY worker, \"check\""),
    "failure_categories": (_scores(fleet.failure_categories), _RE + "SELECT \"check\", count(*) AS fails FROM sc WHERE status = 'fail' GROUP BY \"check\""),
    "fleet_rollup": (_scores(fleet.fleet_rollup), _RE + "SELECT worker, count(*) AS runs, round(avg(overall), 6) AS mean_score FROM rs GROUP BY ROLLUP (worker)"),
    "grade_histogram": (_stored_scores(lambda c: fleet.grade_histogram(fleet.scorecard(c))), _RE + "SELECT grade, count(*) AS workers FROM card GROUP BY grade"),
    "provenance_unpivot": (_events(claims.run_event_fields), _RE + "SELECT session_id, pos, type, path, value, CASE WHEN path IN ('event_type', 'timestamp', 'tokens_in') THEN 'proof' WHEN path LIKE 'tool_call.%' THEN 'claim' WHEN path = 'output_data' THEN CASE WHEN type = 'tool_call' THEN 'proof' ELSE 'claim' END ELSE 'neutral' END AS provenance FROM (SELECT session_id, pos, type, unnest(['event_type', 'timestamp', 'tokens_in', 'session_id', 'model', 'tool_call.tool_name', 'tool_call.tool_input', 'output_data']) AS path, unnest([type, CAST(ts_ms AS VARCHAR), CAST(tokens AS VARCHAR), session_id, model, CASE WHEN type = 'tool_call' THEN CAST(tool AS VARCHAR) END, CASE WHEN type = 'tool_call' THEN tool_sig END, tool_sig]) AS value FROM re) WHERE value IS NOT NULL"),
    "provenance_counts": (_events(lambda e: claims.provenance_counts(claims.run_event_fields(e))), _RE + "SELECT session_id, CAST(sum(CASE WHEN type = 'tool_call' THEN 4 ELSE 3 END) AS BIGINT) AS proof, CAST(sum(CASE WHEN type = 'tool_call' THEN CASE WHEN tool IS NULL THEN 1 ELSE 2 END ELSE 1 END) AS BIGINT) AS claim, CAST(sum(2) AS BIGINT) AS neutral FROM re GROUP BY session_id"),
    "calibration_rollup": (lambda s, d: judge.calibration(_judged(s, d)), _JUDGED + f"SELECT criterion, {_RATES}, CASE WHEN avg(CAST(abs(actual - expected) <= 1 AS INT)) >= 0.8 THEN 1 ELSE 0 END AS reliable FROM j GROUP BY criterion"),
    "calibrated": (lambda s, d: judge.calibrated(_judged(s, d)), _JUDGED + f"SELECT *, CASE WHEN within_one >= 0.85 AND exact >= 0.5 AND abs(bias) <= 0.5 THEN 1 ELSE 0 END AS calibrated FROM (SELECT {_RATES} FROM j)"),
    "calibration_drift": (
        lambda s, d: judge.calibration_drift(_judged(s, d).where("expected = 5"), _judged(s, d)),
        _JUDGED + ", m AS (SELECT criterion, actual - expected AS x, 1 AS now FROM j UNION ALL SELECT criterion, actual - expected, 0 FROM j WHERE expected = 5), g AS (SELECT criterion, now, avg(x) AS bias, avg(abs(x)) AS mae, avg(CAST(abs(x) <= 1 AS INT)) AS near FROM m GROUP BY GROUPING SETS ((criterion, now), (now))), k AS (SELECT b.criterion, b.bias - a.bias AS bd, CASE WHEN b.criterion IS NULL THEN b.near - a.near ELSE b.mae - a.mae END AS md FROM g b JOIN g a ON b.criterion IS NOT DISTINCT FROM a.criterion AND b.now = 1 AND a.now = 0) SELECT criterion, round(bd, 6) AS bias_delta, round(md, 6) AS mae_delta, CASE WHEN abs(bd) > 0.1 OR abs(md) > 0.1 THEN 1 ELSE 0 END AS drifted FROM k",
    ),
    "consensus_upper_median": (lambda s, d: judge.consensus(_judged(s, d)), _JUDGED + "SELECT criterion, count(*) AS n, list_sort(list(actual))[count(*) // 2 + 1] AS median, min(actual) AS lowest, max(actual) AS highest, CASE WHEN max(actual) - min(actual) > 1 THEN 1 ELSE 0 END AS disagreed FROM j GROUP BY criterion"),
    "verdict_weighted": (_verdicts, _JUDGED + "SELECT criterion AS item, round(s, 6) AS score, round(c, 6) AS confidence, CASE WHEN c < 0.7 THEN 'needs-human-review' WHEN s >= 0.6 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT criterion, sum((actual - 1) / 4.0 * expected) / sum(expected) AS s, avg(CASE WHEN actual = 3 THEN 0.5 ELSE 0.9 END) AS c FROM j GROUP BY criterion)"),
    "assertions": (_docs(_asserted), _ASSERTED),
    "assertions_negated": (
        _docs(lambda d: A.assert_all(d, "doc_id", A.negated({"contains": A.contains(F.col("text"), "the"), "match": A.matches(F.col("text"), "[0-9]{16}")}) | {"equal": A.equals(F.col("text"), "the")})),
        "SELECT doc_id, unnest(['not contains', 'not match', 'equal']) AS assertion, unnest(list_transform([NOT contains(text, 'the'), NOT regexp_matches(text, '[0-9]{16}'), text = 'the'], lambda b: CASE WHEN b THEN 'pass' ELSE 'fail' END)) AS status FROM documents",
    ),
    "full_repetition": (_docs(lambda d: repetition.full_repetition(d, _ngram_saturation(d), "doc_id")), None),
    "keyword_coverage": (_docs(lambda d: d.select("doc_id", A.keyword_coverage(F.col("text"), _KEYWORDS).alias("coverage"))), "SELECT doc_id, round((" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in _KEYWORDS) + f") / {len(_KEYWORDS)}.0, 6) AS coverage FROM documents"),
    "score_upsert": (_docs(_upserted, "lineitem"), "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1"),
    "similar_documents": (
        _docs(lambda d: similar.similar_items(d, "doc_id", similar.word_set("text"))),
        f"""WITH w AS (SELECT doc_id, list_sort(list_distinct({_words("lower(text)")})) AS s FROM documents), c AS (SELECT min(doc_id) AS class_id, s, len(s) AS n FROM w GROUP BY s),
p AS (SELECT a.class_id AS x, b.class_id AS y, len(list_intersect(a.s, b.s)) AS i, a.n + b.n AS m FROM c a JOIN c b ON a.class_id < b.class_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 AND a.n > 0),
l AS (SELECT class_id, count(*) AS k FROM (SELECT unnest([x, y]) AS class_id FROM p WHERE i * 100 >= (m - i) * 85) GROUP BY class_id)
SELECT doc_id, c.class_id, coalesce(k, 0) AS n_links FROM w JOIN c USING (s) LEFT JOIN l USING (class_id)""",
    ),
    "unjudged_anti_join": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "source"), "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "judged_semi_join": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_semi").select("doc_id", "source"), "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "content_metrics": (
        _docs(lambda d: d.select("doc_id", F.length("text").cast("long").alias("n_chars"), T.count_words(F.col("text")).alias("n_words"), T.count_lines(F.col("text")).alias("n_lines"), T.count_paragraphs(F.col("text")).alias("n_paragraphs"), T.unique_word_ratio(F.col("text")).alias("unique_ratio"), T.tokens_estimate(F.col("text")).alias("tokens"))),
        f"SELECT doc_id, length(text) AS n_chars, len({_words('text')}) AS n_words, len({_LINES}) AS n_lines, len(list_filter(regexp_split_to_array(text, '\\n[ \\t\\n\\r]*\\n'), lambda p: regexp_matches(p, '[^ \\t\\n\\r]'))) AS n_paragraphs, CASE WHEN len({_words('text')}) > 0 THEN round(len(list_distinct({_words('lower(text)')})) / CAST(len({_words('text')}) AS DOUBLE), 6) END AS unique_ratio, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    ),
    "duplicate_line_runs": (
        _docs(lambda d: d.select("doc_id", T.longest_duplicate_run(F.col("text")).alias("longest"))),
        f"WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM documents), r AS (SELECT doc_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS grp FROM l) GROUP BY doc_id, line, grp) SELECT d.doc_id, coalesce(max(n), 0) AS longest FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id",
    ),
    "ngram_saturation": (
        _docs(_ngram_saturation),
        r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \t\n\r]', '', 'g'), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3), c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rn FROM c) SELECT doc_id, round(sum(CASE WHEN rn <= 5 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS score, count(*) AS unique_grams, CAST(sum(n) AS BIGINT) AS total_grams FROM r GROUP BY doc_id",
    ),
    "task_answer_jaccard": (
        _docs(lambda c: _pairs(c).where("task is not null and answer is not null").select("conv_id", T.jaccard(F.col("task"), F.col("answer")).alias("jaccard")), "conversations"),
        f"WITH p AS ({_FIRST}), q AS (SELECT conv_id, list_distinct({_words('lower(task)')}) AS x, list_distinct({_words('lower(answer)')}) AS y FROM p WHERE task IS NOT NULL AND answer IS NOT NULL) SELECT conv_id, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) END AS jaccard FROM q",
    ),
    "conversation_tokens": (_docs(lambda c: c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(T.tokens_estimate(F.col("text"))).alias("tokens")), "conversations"), "SELECT conv_id, count(*) AS turns, CAST(sum(CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id"),
    "guard_replay": (
        _events(_guarded),
        _RE + """, r0 AS (SELECT *, sum(tokens) OVER w AS total, ts_ms - min(ts_ms) OVER (PARTITION BY session_id) AS age, ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY pos) AS silence, sum(CASE WHEN type = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM re WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
r1 AS (SELECT *, CASE WHEN total >= 300000 THEN 'tokens' WHEN age > 518400000 THEN 'timeout' WHEN silence > 172800000 THEN 'stall' END AS reason FROM r0 WHERE coalesce(ended, 0) = 0),
stops AS (SELECT session_id, reason, ts_ms, CAST(total AS BIGINT) AS tokens FROM r1 WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) = 1)
SELECT * FROM stops UNION ALL SELECT session_id, 'abandoned', last_ms, tokens FROM s WHERE has_end = 0 AND session_id NOT IN (SELECT session_id FROM stops)""",
    ),
    "sql_retry_runs": (
        _events(lambda e: S.retry_runs(traces.tool_outcomes(e))),
        _RE + "SELECT session_id, CAST(tool AS VARCHAR) AS tool, min(pos) AS first_pos, count(*) AS length, arg_min(is_error, pos) = 1 AS failed_first, CAST(sum(is_error) AS BIGINT) AS failures FROM (SELECT *, pos - row_number() OVER (PARTITION BY session_id, tool ORDER BY pos) AS grp FROM oc) GROUP BY session_id, tool, grp",
    ),
    "sql_metrics": (
        _docs(_sql_metrics),
        f"WITH {_claims_sql('documents', 'doc_id', 'text')}, n AS (SELECT doc_id, len(cs) AS k FROM chosen), w AS (SELECT *, {_words("lower(text)")} AS x, {_words("'the version of the text is licensed'")} AS y FROM documents) SELECT w.doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(len(x) AS BIGINT) AS n_words, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, round(len(list_intersect(list_distinct(x), list_distinct(y))) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS jaccard, "
        + "round((" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in _KEYWORDS) + ") / 4.0, 6) AS coverage, CASE WHEN n_chars * 37 < 1000 THEN n_chars * 37 || 'ms' WHEN n_chars * 37 < 60000 THEN format('{:.1f}s', floor(n_chars * 370.0 / 1000 + 0.5) / 10) WHEN n_chars * 37 < 3600000 THEN format('{:.1f}m', floor(n_chars * 370.0 / 60000 + 0.5) / 10) ELSE format('{:.1f}h', floor(n_chars * 370.0 / 3600000 + 0.5) / 10) END AS duration, coalesce(k, 0) AS claims FROM w LEFT JOIN n USING (doc_id)",
    ),
    "judge_inputs": (_docs(_judge_inputs, "conversations"), _JUDGE_INPUTS),
    "judged_within_ceiling": (
        _events(lambda e: projection.within_ceiling(sessions.sessions(e), "session_id", "first_ms", F.least("tokens", F.lit(8000)) / 1_000_000 * 0.59 + projection.ANSWER / 1_000_000 * 0.79, 1.0)),
        _RE + "SELECT session_id, cost, round(running, 6) AS running FROM (SELECT session_id, cost, sum(cost) OVER (ORDER BY first_ms DESC, session_id ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT *, least(tokens, 8000) / 1000000.0 * 0.59 + 4096 / 1000000.0 * 0.79 AS cost FROM s)) WHERE running <= 1.0",
    ),
    "url_well_formed": (_docs(lambda p: p.select("page_id", T.url_well_formed(F.col("url")).alias("well_formed"), T.slug(F.col("url")).alias("slug")), "pages"), r"SELECT page_id, CAST(coalesce(regexp_matches(url, '^https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(:[0-9]+)?([/?#][^ ]*)?$'), false) AS INT) AS well_formed, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages"),
}
REGISTRY |= TEXT_QUERIES | RULE_QUERIES | store_queries.registry(_RE)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
