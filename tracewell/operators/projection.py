"""What a judge is shown of a run, cut to a budget of tokens, and how many runs a budget of money pays for.

A run stays one row: output, task and a short array of artifacts. All shares are arithmetic on the row; a running cost is a sum over days before and rows within a day, so no task holds all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import tokens_estimate
from tracewell.sources import transcripts as T

#: Tokens of a judge's input, shares of output and task in them, least tokens of an artifact, share of a cut text that is kept at its head, and tokens of an answer.
CAP, OUTPUT, TASK, LEAST, HEAD, ANSWER = 8000, 0.4, 0.1, 200, 0.6, 4096
ARTIFACT = "array<struct<name:string,text:string>>"
#: Fixed: lines of a transcript's actions that tell the agent's own reasons.
DECISION = r"(?i)^\s*\d+\.\s*\(decision\)"


def judged_view(transcripts: DataFrame) -> DataFrame:
    """(worker, run_id, output, task, artifacts, reasoning_stripped) of transcripts: evidence only. Lines of actions that are the agent's reasons go; outcome and duration are a record of the run."""
    body = T.sections(transcripts).groupBy("worker", "run_id").pivot("slug", ["task", "actions taken", "key outputs", "outcome", "errors & retries", "duration"]).agg(F.first("body"))
    df = transcripts.select("worker", "run_id").join(body, ["worker", "run_id"], "left")
    some = lambda c: F.nullif(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))), F.lit(""))
    lines = F.split(F.coalesce("`actions taken`", F.lit("")), "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(DECISION))
    named = lambda name, text: F.when(text.isNotNull(), F.struct(F.lit(name).alias("name"), text.alias("text")))
    record = F.nullif(F.concat_ws("\n", some("outcome"), some("duration")), F.lit(""))
    artifacts = F.array_compact(F.array(named("actions_taken", F.nullif(F.trim(F.array_join(kept, "\n")), F.lit(""))), named("errors_and_retries", some("errors & retries")), named("execution_record", record)))
    return df.select("worker", "run_id", F.coalesce(some("key outputs"), F.lit("(no output recorded)")).alias("output"), F.coalesce(some("task"), F.lit("(no task recorded)")).alias("task"), artifacts.alias("artifacts"), (F.size(kept) < F.size(lines)).alias("reasoning_stripped"))


def cut_to(text: Column, most: Column) -> Column:
    """A text of more than `most` tokens as its head and tail, with a line between that says how much went."""
    keep = most * 4
    head = F.floor(keep * HEAD).cast("int")
    tail = (keep - head).cast("int")
    gone = F.format_string("\n...[truncated %d tokens]...\n", tokens_estimate(text) - most)
    return F.when(tokens_estimate(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), head), gone, F.right(text, tail)))


def token_capped(df: DataFrame, cap: int = CAP) -> DataFrame:
    """df (output, task, artifacts and more) with the three cut to `cap` tokens in all, and truncated, input_tokens. The output gets OUTPUT of the budget, the task TASK, the artifacts even shares of what is left, LEAST each at least; while that is too much, the largest artifact (of equals the first) is cut at its end, and
    once none has anything left they go."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    artifacts = F.coalesce(F.col("artifacts").cast(ARTIFACT), F.array().cast(ARTIFACT))
    before = df.select("*", F.struct(whole("output").alias("output"), whole("task").alias("task"), artifacts.alias("artifacts")).alias("_old"))
    out = before.withColumns({"output": cut_to(whole("output"), F.lit(int(cap * OUTPUT))), "task": cut_to(whole("task"), F.lit(int(cap * TASK)))})
    out = out.withColumn("_fixed", tokens_estimate(F.col("output")) + tokens_estimate(F.col("task")))
    share = F.greatest(F.floor((cap - F.col("_fixed")) / F.greatest(F.size("_old.artifacts"), F.lit(1))), F.lit(LEAST))
    out = out.withColumn("_share", share)
    out = out.withColumn("artifacts", F.transform("_old.artifacts", lambda a: F.struct(a["name"].alias("name"), cut_to(F.coalesce(a["text"], F.lit("")), F.col("_share")).alias("text"))))
    spent = lambda listed: F.aggregate(listed, F.lit(0).cast("long"), lambda n, a: n + tokens_estimate(a["text"]))
    # each step ends the excess or empties an artifact, so there are no more steps than artifacts
    steps = F.when(F.size("artifacts") > 0, F.sequence(F.lit(1), F.size("artifacts"))).otherwise(F.array().cast("array<int>"))

    def trimmed(listed: Column) -> Column:
        over = spent(listed) + F.col("_fixed") - cap
        most = F.array_max(F.transform(listed, lambda a: tokens_estimate(a["text"])))
        at = F.array_position(F.transform(listed, lambda a: tokens_estimate(a["text"])), most) - 1
        shorter = lambda a: F.struct(a["name"].alias("name"), F.left(a["text"], F.greatest(F.lit(0), F.length(a["text"]) - (over * 4 + 8).cast("int"))).alias("text"))
        return F.when(over <= 0, listed).otherwise(F.transform(listed, lambda a, i: F.when(i == at, shorter(a)).otherwise(a)))

    out = out.withColumn("artifacts", F.aggregate(steps, F.col("artifacts").cast(ARTIFACT), lambda listed, _: trimmed(listed).cast(ARTIFACT)))
    left = F.when(spent(F.col("artifacts")) + F.col("_fixed") <= cap, F.col("artifacts")).otherwise(F.filter("artifacts", lambda a: a["text"] != ""))
    out = out.withColumn("artifacts", left).withColumn("input_tokens", F.col("_fixed") + spent(F.col("artifacts")))
    same = F.struct("output", "task", F.col("artifacts").cast(ARTIFACT).alias("artifacts"))
    return out.withColumn("truncated", ~same.eqNullSafe(F.col("_old"))).drop("_old", "_fixed", "_share")


def within_ceiling(df: DataFrame, item: str, newest: str, cost: Column, ceiling: float, span: int = 86_400_000) -> DataFrame:
    """(item, cost, running): the newest items, by the column `newest`, whose costs together stay within a ceiling; the first that would not ends the list. Costs are not negative. Sums run within a span of `newest` and over spans."""
    rows = df.select(item, F.col(newest).alias("_at"), cost.alias("cost")).withColumn("_span", F.floor(F.col("_at") / span))
    inside = F.sum("cost").over(Window.partitionBy("_span").orderBy(F.col("_at").desc_nulls_last(), item).rowsBetween(Window.unboundedPreceding, 0))
    # a row for each span
    spans = rows.groupBy("_span").agg(F.sum("cost").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy(F.col("_span").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    offsets = spans.select(F.col("_span").alias("_s"), before.alias("_before"))
    both = rows.withColumn("_inside", inside).join(offsets, F.col("_span").eqNullSafe(F.col("_s")))
    return both.withColumn("running", F.col("_before") + F.col("_inside")).where(F.col("running") <= ceiling).select(item, "cost", F.round("running", 6).alias("running"))
