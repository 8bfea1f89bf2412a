"""Session operators: per-session facts, staleness issues, triage. Input: run events (session_id, pos, ts_ms, type, tokens, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def in_session():
    """Events of a session in order."""
    return Window.partitionBy("session_id").orderBy("pos")

OUTPUTS = ("output", "tool_call", "tool_result")
#: A further call of an event that has several: it counts as a call, not as an event.
FURTHER_CALL = "further_call"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the detectors and of triage; the defaults are those of interactive agents."""

    max_gap_ms: int = 300_000
    min_events: int = 2
    max_heartbeats: int = 5
    timeout_ms: int | None = None
    costly_tokens: int = 200_000
    costly_ms: int = 600_000
    over_cost_tokens: int = 1_000_000
    over_latency_ms: int = 1_800_000
    most_steps: int = 400
    loop_share: float = 0.5
    least_segments: int = 4
    dollars_per_million: float = 9.0


#: For sessions that last days.
WEEKLY = Limits(max_gap_ms=172_800_000, timeout_ms=518_400_000, costly_ms=432_000_000, over_latency_ms=518_400_000)


def round6(x: Column) -> Column:
    return F.round(x, 6)


def islands(events: DataFrame, same: list[str]) -> DataFrame:
    """Runs of neighbouring events that agree in `same`: (session_id, *same, first_pos, length)."""
    by = Window.partitionBy("session_id", *same).orderBy("pos")
    return events.withColumn("run", F.col("pos") - F.row_number().over(by)).groupBy("session_id", *same, "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("length")).drop("run")


def gaps(events: DataFrame) -> DataFrame:
    """(session_id, max_gap_ms, n_gaps): over neighbouring events; one event has no gap."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(in_session())
    return events.withColumn("gap", gap).groupBy("session_id").agg(F.max("gap").alias("max_gap_ms"), F.count("gap").alias("n_gaps"))


def heartbeat_runs(events: DataFrame) -> DataFrame:
    """(session_id, longest): the longest run of heartbeats, of sessions that have any."""
    return facts(events).where("longest_beats > 0").select("session_id", F.col("longest_beats").alias("longest"))


def tool_loops(events: DataFrame) -> DataFrame:
    """(session_id, n_calls, top_sig, top_count, share, streak) over tool calls; of equally frequent signatures the first seen."""
    return facts(events).where("n_calls > 0").select("session_id", "n_calls", "top_sig", "top_count", round6(F.col("top_count") / F.col("n_calls")).alias("share"), "streak")


def sessions(events: DataFrame) -> DataFrame:
    """One row a session: times, counts, tokens and how it ended (cleanly: the last event is an end and none is an error)."""
    agg = events.groupBy("session_id").agg(
        F.min("worker").alias("worker"),
        F.min("model").alias("model"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("type") == "error").alias("n_errors"),
        F.count_if(F.col("type").isin(*OUTPUTS)).alias("n_outputs"),
        F.sum("tokens").alias("tokens"),
        F.max_by("type", "pos").alias("last_type"),
        F.max((F.col("type") == "end").cast("int")).alias("has_end"),
    )
    return _ended(agg)


def stuck_outputs(events: DataFrame) -> DataFrame:
    """(session_id, n, growing) of sessions with two outputs or more that have text: whether any is longer than the one before it."""
    said = events.where(F.col("type").isin(*OUTPUTS) & F.col("text").isNotNull()).select("session_id", "pos", F.length("text").alias("size"))
    grown = F.coalesce(F.col("size") > F.lag("size").over(in_session()), F.lit(False))
    return said.withColumn("grown", grown).groupBy("session_id").agg(F.count("*").alias("n"), F.max("grown").alias("growing")).where("n >= 2")


def _ended(agg: DataFrame) -> DataFrame:
    clean = (F.col("last_type") == "end") & (F.col("n_errors") == 0)
    return agg.withColumn("runtime_ms", F.col("last_ms") - F.col("first_ms")).withColumn("clean", clean.cast("int"))


def facts(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All that sessions, issues, loops and scores need, one row a session, in one pass: events are dealt out by session once; running values, then counts by call signature, then the session's totals stay where they are.

    To the columns of `sessions` come n_stale (gaps over the limit), longest_beats, n_calls, top_sig, top_count, streak.
    """
    now = in_session().rowsBetween(Window.unboundedPreceding, 0)
    call, beat = F.col("type").isin("tool_call", FURTHER_CALL), F.col("type") == "heartbeat"
    sig = F.when(call, F.coalesce("tool_sig", F.lit("")))
    df = events.withColumns(
        {
            "gap": F.col("ts_ms") - F.lag("ts_ms").over(in_session()),
            "beats": F.col("pos") - F.coalesce(F.max(F.when(~beat, F.col("pos"))).over(now), F.min("pos").over(now) - 1),
            "call_no": F.count(sig).over(now),
            "sig": sig,
            "sig_before": F.last(sig, ignorenulls=True).over(in_session().rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    fresh = call & (F.col("sig_before").isNull() | (F.col("sig_before") != F.col("sig")))
    df = df.withColumn("streak", F.when(call, F.col("call_no") - F.max(F.when(fresh, F.col("call_no"))).over(now) + 1))
    each = df.groupBy("session_id", "sig").agg(
        F.min("worker").alias("worker"),
        F.min("model").alias("model"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.count("*").alias("n"),
        F.count_if(F.col("type") != FURTHER_CALL).alias("n_events"),
        F.count_if(F.col("type") == "error").alias("n_errors"),
        F.count_if(F.col("type").isin(*OUTPUTS)).alias("n_outputs"),
        F.sum("tokens").alias("tokens"),
        F.max(F.struct("pos", "type")).alias("last"),
        F.max((F.col("type") == "end").cast("int")).alias("has_end"),
        F.count_if(F.col("gap") > limits.max_gap_ms).alias("n_stale"),
        F.max("beats").alias("beats"),
        F.max("streak").alias("streak"),
        F.min("call_no").alias("first_call"),
    )
    called = F.col("sig").isNotNull()
    agg = each.groupBy("session_id").agg(
        F.min("worker").alias("worker"),
        F.min("model").alias("model"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.sum("n_events").alias("n_events"),
        F.sum("n_errors").alias("n_errors"),
        F.sum("n_outputs").alias("n_outputs"),
        F.sum("tokens").alias("tokens"),
        F.max("last").alias("last"),
        F.max("has_end").alias("has_end"),
        F.sum("n_stale").alias("n_stale"),
        F.max(F.when(~called, F.col("beats"))).alias("longest_beats"),
        F.sum(F.when(called, F.col("n")).otherwise(0)).alias("n_calls"),
        F.max("streak").alias("streak"),
        F.max(F.when(called, F.struct("n", -F.col("first_call"), "sig"))).alias("top"),
    )
    agg = agg.withColumn("last_type", F.col("last.type")).withColumn("top_sig", F.col("top.sig")).withColumn("top_count", F.col("top.n")).withColumn("longest_beats", F.coalesce("longest_beats", F.lit(0)))
    return _ended(agg.drop("last", "top"))


#: Kinds of issues in the order in which they are listed, each with its severity.
ISSUES = [("timeout", "error"), ("no_output", "error"), ("stale_gap", "warning"), ("no_end", "warning"), ("abandoned", "warning"), ("abandoned", "error"), ("no_progress", "error"), ("no_progress", "warning")]
#: What only a source can tell: a timeout that it recorded, and the signs in a session's last text, by kind and severity.
TOLD = ["told_timeout", "told_abandoned", "told_unbalanced", "told_repeating"]


def _counted(limits: Limits) -> list[Column]:
    """How often each of ISSUES fires, from facts and TOLD."""
    one = lambda x: F.coalesce(x, F.lit(False)).cast("long")
    late = F.lit(False) if limits.timeout_ms is None else F.col("runtime_ms") > limits.timeout_ms
    start = [one(late | (F.col("told_timeout") > 0)), one(F.col("n_events") < limits.min_events), F.coalesce("n_stale", F.lit(0)).cast("long"), one((F.col("has_end") == 0) & (F.col("n_events") > 0))]
    return [*start, F.col("told_abandoned"), F.col("told_unbalanced"), one(F.col("n_outputs") == 0), one(F.col("longest_beats") > limits.max_heartbeats) + F.col("told_repeating")]


def issue_list(df: DataFrame, limits: Limits) -> DataFrame:
    """facts with `issues`, an array of those that fire: (kind, severity, n)."""
    df = df.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) if c in df.columns else F.lit(0).cast("long") for c in TOLD})
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), n.alias("n")) for (k, s), n in zip(ISSUES, _counted(limits))))
    return df.withColumn("issues", F.filter(every, lambda i: i["n"] > 0))


def _sum(issues: str, severity: str | None = None) -> Column:
    return F.aggregate(issues, F.lit(0).cast("long"), lambda acc, i: acc + (i["n"] if severity is None else F.when(i["severity"] == severity, i["n"]).otherwise(0)))


def issues(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(session_id, kind, severity, n): how often each detector fires in a session."""
    return issue_list(facts(events, limits), limits).select("session_id", F.explode("issues").alias("i")).select("session_id", "i.*")


def stale_sessions(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(session_id, n_issues, n_errors, stale) of sessions with issues: stale with any error, or three issues of any severity."""
    per = issue_list(facts(events, limits), limits).where(F.size("issues") > 0).select("session_id", _sum("issues").alias("n_issues"), _sum("issues", "error").alias("n_errors"))
    return per.withColumn("stale", ((F.col("n_errors") > 0) | (F.col("n_issues") >= 3)).cast("int"))


def triage_facts(df: DataFrame, limits: Limits = Limits(), stale_only: bool = True) -> DataFrame:
    """One row a flagged session from facts, with aborted, timed_out and text_ratio (of repeated assistant text) where the source tells them.

    Unclean sessions are flagged if stale (all, if not stale_only), clean ones if over a budget. issue_kinds lists all budgets that a clean one broke, all kinds of issues of another. The share of the most frequent call counts as a loop only if its
    signature has arguments; a bare name counts by its streak.
    """
    df = issue_list(df, limits)
    told = lambda c, default: F.coalesce(F.col(c), default) if c in df.columns else default
    aborted = told("aborted", ((F.col("has_end") == 0) & (F.col("n_errors") == 0)).cast("int")) == 1
    kinds, n_issues, n_errors = F.array_distinct(F.transform("issues", lambda i: i["kind"])), _sum("issues"), _sum("issues", "error")
    share, streak = (F.round(F.col(c) / F.col("n_calls"), 6) for c in ("top_count", "streak"))
    specific = F.coalesce(F.col("top_sig").rlike("\\([^)]"), F.lit(False))
    calls = F.when(F.col("n_calls") >= limits.least_segments, F.when(specific, F.greatest(share, streak)).otherwise(streak)).otherwise(0.0)
    loop = F.greatest(F.coalesce(calls, F.lit(0.0)), told("text_ratio", F.lit(0.0)))
    steps = F.greatest(F.col("n_events"), told("n_assistant", F.lit(0).cast("long")))
    budgets = [("over-cost", F.col("tokens") >= limits.over_cost_tokens), ("over-latency", F.col("runtime_ms") >= limits.over_latency_ms), ("excessive-steps", steps >= limits.most_steps), ("loop-without-progress", loop >= limits.loop_share)]
    tripped = F.array_compact(F.array(*(F.when(over, F.lit(name)) for name, over in budgets)))
    broken = (
        F.when((told("timed_out", F.lit(0)) == 1) | F.array_contains(kinds, "timeout"), "timeout")
        .when(F.array_contains(kinds, "abandoned") | aborted, "abandoned")
        .when(F.col("tokens") >= limits.over_cost_tokens, "runaway")
        .when(F.arrays_overlap(kinds, F.array(F.lit("stale_gap"), F.lit("no_progress"))), "stalled")
        .otherwise("errored")
    )
    stale = (n_errors > 0) | (n_issues >= 3) if stale_only else F.lit(True)
    clean = F.col("clean") == 1
    df = df.withColumns({"tripped": F.when(clean, tripped).otherwise(kinds), "flagged": F.when(clean, F.size(tripped) > 0).otherwise(stale)}).where("flagged")
    costly = (F.col("tokens") >= limits.costly_tokens) | F.coalesce(F.col("runtime_ms") >= limits.costly_ms, F.lit(False))
    cost = F.col("tokens") / 1_000_000 * limits.dollars_per_million
    kind = F.when(clean, F.get("tripped", F.lit(0))).otherwise(broken)
    return df.select("session_id", kind.alias("kind"), "tokens", "runtime_ms", costly.cast("int").alias("costly"), round6(cost).alias("projected_usd"), F.array_join("tripped", ",").alias("issue_kinds"))


def triage(events: DataFrame, limits: Limits = Limits(), stale_only: bool = True) -> DataFrame:
    """`triage_facts` of run events."""
    return triage_facts(facts(events, limits), limits, stale_only)


def triage_built(built: DataFrame, events: DataFrame, limits: Limits = Limits(), stale_only: bool = True) -> DataFrame:
    """`triage_facts` of sessions that a reader built: what the source says of each (tokens, runtime_ms, clean, aborted, timed_out, n_assistant, text_ratio, TOLD) goes before what its events (session_id, pos, ts_ms, type, tool_sig) tell. Sessions without events are kept."""
    # only what comes of events stays, but for what the source leaves open
    seen = facts(events.withColumns({"worker": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "tokens": F.lit(0).cast("long")}), limits).drop("worker", "model", "tokens", "clean", "first_ms", "last_ms")
    seen = seen.withColumnRenamed("runtime_ms", "seen_ms").withColumnsRenamed({c: f"seen_{c}" for c in ("n_events", "n_errors")})
    own = [c for c in built.columns if c not in ("n_events", "n_errors")]
    df = built.select(*own).join(seen, "session_id", "left").fillna(0, ["seen_n_events", "seen_n_errors", "n_outputs", "has_end", "n_stale", "longest_beats", "n_calls"])
    df = df.withColumn("runtime_ms", F.coalesce("runtime_ms", "seen_ms")).withColumnsRenamed({"seen_n_events": "n_events", "seen_n_errors": "n_errors"})
    return triage_facts(df, limits, stale_only)


def triage_by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def triage_totals(rows: DataFrame) -> DataFrame:
    """Flagged and costly sessions, and what the costly ones are projected to cost."""
    return rows.agg(F.count("*").alias("flagged"), F.count_if(F.col("costly") == 1).alias("costly"), F.coalesce(F.round(F.sum(F.when(F.col("costly") == 1, F.col("projected_usd"))), 4), F.lit(0.0)).alias("projected_usd"))


def triage_top(rows: DataFrame, k: int = 15) -> DataFrame:
    """The worst sessions first: costly, tokens, runtime, then id."""
    return rows.orderBy(F.desc("costly"), F.desc("tokens"), F.desc("runtime_ms"), "session_id").limit(k)
