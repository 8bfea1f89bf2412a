"""Trace operators: tool footprint, retries, recovery, token totals, and selection among agent configurations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.sessions import in_session, round6

#: Fixed weights of a candidate's sub-scores.
WEIGHTS = {"contradictions": 2.0, "error_rate": 1.0, "recovery": 1.0, "thrash": 1.0, "steps": 1.0, "cost": 0.5}


def tool_outcomes(events: DataFrame) -> DataFrame:
    """(session_id, model, pos, tool, is_error, tokens): calls and errors are tool outcomes, numbered anew."""
    calls = events.where("type in ('tool_call', 'error')").select("session_id", "model", "pos", "tool", (F.col("type") == "error").cast("int").alias("is_error"), "tokens")
    return calls.withColumn("pos", F.row_number().over(in_session()))


def _runs(outcomes: DataFrame) -> DataFrame:
    """Outcomes with their place in a run of one tool (streak), whether the run's first call failed (head_error), and whether a later call succeeds, all over one order of each session."""
    now, after = in_session().rowsBetween(Window.unboundedPreceding, 0), in_session().rowsBetween(1, Window.unboundedFollowing)
    before = F.lag("tool").over(in_session())
    fresh = F.lag("pos").over(in_session()).isNull() | ~before.eqNullSafe(F.col("tool"))
    df = outcomes.withColumns({"head": F.when(fresh, F.col("pos")), "later_success": F.max(1 - F.col("is_error")).over(after)})
    df = df.withColumn("streak", F.col("pos") - F.max("head").over(now) + 1)
    return df.withColumn("head_error", F.last(F.when(F.col("head").isNotNull(), F.col("is_error")), ignorenulls=True).over(now))


def _measured(runs: DataFrame) -> DataFrame:
    """Counts of each session in one aggregation. A run counts as a retry if its first call failed: streaks of two calls at least, each call after the first one retry."""
    again = (F.col("streak") >= 2) & (F.col("head_error") == 1)
    fails = F.col("is_error") == 1
    df = runs.groupBy("session_id").agg(
        F.min("model").alias("model"),
        F.count("*").alias("tool_calls"),
        F.sum("is_error").alias("tool_errors"),
        F.sum("tokens").alias("tokens"),
        F.max(F.when(again, F.col("streak")).otherwise(0)).cast("long").alias("longest_streak"),
        F.count_if(again).alias("retry_count"),
        F.count_if(fails & (F.col("later_success") == 1)).alias("recovered"),
        F.count_if(fails & (F.col("later_success") == 0)).alias("unrecovered"),
    )
    total = F.col("recovered") + F.col("unrecovered")
    return df.withColumns({"error_rate": round6(F.col("tool_errors") / F.col("tool_calls")), "recovery_rate": F.when(total == 0, 1.0).otherwise(round6(F.col("recovered") / total))})


def retries(outcomes: DataFrame) -> DataFrame:
    """(session_id, longest_streak, retry_count): runs of one tool, two calls at least, whose first call failed."""
    return _measured(_runs(outcomes)).select("session_id", "longest_streak", "retry_count")


def recovery(outcomes: DataFrame) -> DataFrame:
    """(session_id, recovered, unrecovered, recovery_rate): failed calls but the last, by whether a later call succeeds."""
    return _measured(_runs(outcomes)).select("session_id", "recovered", "unrecovered", "recovery_rate")


def footprint(events: DataFrame) -> DataFrame:
    """One row a session with tool calls: calls, errors, rate, retries, recovery, tokens."""
    return _measured(_runs(tool_outcomes(events))).select("session_id", "model", "tool_calls", "tool_errors", "tokens", "error_rate", "longest_streak", "retry_count", "recovered", "unrecovered", "recovery_rate")


def _lower_better(x: Column, most: Column) -> Column:
    return F.when(most <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - x / most)))


def select_candidates(footprints: DataFrame, max_error_rate: float = 0.5) -> DataFrame:
    """Candidates (models under one harness) ranked by weighted sub-scores; equal candidates share a rank. No claims are falsified here, so integrity is left out and contradictions count as none."""
    per = footprints.groupBy("model").agg(
        F.count("*").alias("runs"),
        F.avg("tool_calls").alias("steps"),
        F.avg("error_rate").alias("error_rate"),
        F.avg("recovery_rate").alias("recovery"),
        F.avg("longest_streak").alias("thrash"),
        F.avg("tokens").alias("cost"),
        F.min(((F.col("error_rate") <= max_error_rate) & (F.col("longest_streak") <= 2)).cast("int")).alias("clean_run"),
    )
    everyone = Window.partitionBy()
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    subs = {
        "contradictions": F.lit(1.0),
        "error_rate": clamp(1 - F.col("error_rate")),
        "recovery": clamp(F.col("recovery")),
        "thrash": clamp(1 - F.col("thrash") / 5),
        "steps": _lower_better(F.col("steps"), F.max("steps").over(everyone)),
        "cost": _lower_better(F.col("cost"), F.max("cost").over(everyone)),
    }
    score = sum((v * WEIGHTS[k] for k, v in subs.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    df = per.withColumn("score", F.floor(score * 1000 + 0.5) / 1000)
    ranked = F.rank().over(Window.orderBy(F.desc("score"), F.desc("clean_run")))
    return df.select("model", "runs", "score", "clean_run", ranked.cast("long").alias("rank"))


#: Fixed weights of all sub-scores, claims included.
CLAIM_WEIGHTS = {"integrity": 2.0} | WEIGHTS


def sane_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """The fixed weights, with those given that are finite and not negative in their place."""
    return CLAIM_WEIGHTS | {k: float(v) for k, v in (weights or {}).items() if k in CLAIM_WEIGHTS and isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) and v >= 0}


def runs_with_claims(footprints: DataFrame, integrity: DataFrame) -> DataFrame:
    """footprints with what was checked of each session's claims (claims.claim_integrity); sessions that claim nothing have no contradictions, and no integrity."""
    found = integrity.select("session_id", "contradicted", "unverifiable", "integrity")
    return footprints.join(found, "session_id", "left").fillna(0, ["contradicted", "unverifiable"])


def rank_selection(runs: DataFrame, name: str = "model", fixed: list[str] | None = None, weights: dict[str, float] | None = None, max_error_rate: float = 0.5) -> DataFrame:
    """Candidates (values of `name`) of each combination of `fixed`, ranked: (fixed..., name, runs, score, contradictions, integrity, clean_run, rank).

    A score is the weighted mean of the sub-scores that there are: integrity is none where no claim of a candidate could be decided, and its weight is left out then. Steps and cost count against the most of the
    candidates compared. Equal scores go by fewer contradictions, more integrity, fewer errors, fewer steps, fewer tokens; candidates equal in all of these share a rank. Candidates are few beside runs: their windows hold one row each.
    """
    fixed, w = fixed or [], sane_weights(weights)
    per = runs.groupBy(*fixed, name).agg(
        F.count("*").alias("runs"),
        F.avg("tool_calls").alias("steps"),
        F.avg("error_rate").alias("error_rate"),
        F.avg("recovery_rate").alias("recovery"),
        F.avg("longest_streak").alias("thrash"),
        F.avg("tokens").alias("cost"),
        F.avg("integrity").alias("integrity"),
        F.sum("contradicted").alias("contradictions"),
        F.min(((F.col("error_rate") <= max_error_rate) & (F.col("longest_streak") <= 2) & (F.col("contradicted") == 0)).cast("int")).alias("clean_run"),
    )
    beside = Window.partitionBy(*fixed)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    subs = {
        "integrity": F.when(F.col("integrity").isNotNull(), clamp(F.col("integrity"))),
        "contradictions": F.when(F.col("contradictions") == 0, 1.0).otherwise(0.0),
        "error_rate": clamp(1 - F.col("error_rate")),
        "recovery": clamp(F.col("recovery")),
        "thrash": clamp(1 - F.col("thrash") / 5),
        "steps": _lower_better(F.col("steps"), F.max("steps").over(beside)),
        "cost": _lower_better(F.col("cost"), F.max("cost").over(beside)),
    }
    total = sum((F.when(v.isNotNull(), w[k]).otherwise(0.0) for k, v in subs.items()), F.lit(0.0))
    weighted = sum((F.coalesce(v, F.lit(0.0)) * w[k] for k, v in subs.items()), F.lit(0.0))
    scored = per.withColumns({"total": total, "weighted": weighted})
    # ranked by whole scores, up to what sums in another order may change; shown in thousandths
    whole = F.when(F.col("total") > 0, F.round(clamp(F.col("weighted") / F.col("total")), 12)).otherwise(0.0)
    order = [F.desc("whole"), F.asc("contradictions"), F.coalesce("integrity", F.lit(-1.0)).desc(), *(F.asc(c) for c in ("error_rate", "steps", "cost"))]
    ranked = scored.withColumn("whole", whole).withColumn("score", F.floor(F.col("whole") * 1000 + 0.5) / 1000).withColumn("rank", F.rank().over(Window.partitionBy(*fixed).orderBy(*order)).cast("long"))
    return ranked.select(*fixed, name, "runs", "score", "contradictions", F.round("integrity", 6).alias("integrity"), "clean_run", "rank")


def ranking_summary(ranking: DataFrame, name: str = "model", fixed: list[str] | None = None) -> DataFrame:
    """(fixed..., winner, chain) of each ranking: the candidate that alone has rank 1 (null if none does), and all candidates, best first, joined by > or, where they share a rank, by =."""
    rows = F.array_sort(F.collect_list(F.struct("rank", name)))
    out = ranking.groupBy(*(fixed or [])).agg(rows.alias("rows"))
    joined = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.struct(F.get("rows", F.lit(0))["rank"].alias("rank"), F.get("rows", F.lit(0))[name].cast("string").alias("chain")), lambda a, x: F.struct(x["rank"].alias("rank"), F.concat(a["chain"], F.when(x["rank"] == a["rank"], " = ").otherwise(" > "), x[name].cast("string")).alias("chain")))
    alone = F.size(F.filter("rows", lambda x: x["rank"] == 1)) == 1
    return out.select(*(fixed or []), F.when(alone, F.get("rows", F.lit(0))[name]).alias("winner"), joined["chain"].alias("chain"))


def winner(ranking: DataFrame) -> DataFrame:
    """The candidate of rank 1, if it alone has it."""
    return ranking.where("rank = 1").withColumn("n", F.count("*").over(Window.partitionBy("rank"))).where("n = 1").select("model", "score")
