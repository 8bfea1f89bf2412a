"""Algebra of judges: verdicts, calibration against expected scores, consensus of samples. Scores are small integers, so groups are reduced to counts by score before anything else."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell.functions import patterns as P

#: The most criteria of a rubric.
MOST_CRITERIA = 1000
#: Fixed thresholds.
RELIABLE, CALIBRATED, EXACT, BIAS, PASS, SURE = 0.8, 0.85, 0.5, 0.5, 0.6, 0.7


def upper_median(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, n, median: the element at place n div 2 of the ordered scores."""
    counts = rows.groupBy(*keys, score).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    up_to = F.sum("c").over(by.orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    df = counts.withColumn("up_to", up_to).withColumn("n", F.sum("c").over(by))
    return df.where(F.col("up_to") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.first("n").alias("n"), F.min(score).alias("median"))


def calibration(pairs: DataFrame) -> DataFrame:
    """(criterion, n, exact, within_one, bias, reliable) of pairs (criterion, expected, actual)."""
    d = F.col("actual") - F.col("expected")
    df = pairs.groupBy("criterion").agg(F.count("*").alias("n"), F.round(F.avg((d == 0).cast("int")), 6).alias("exact"), F.round(F.avg((F.abs(d) <= 1).cast("int")), 6).alias("within_one"), F.round(F.avg(d), 6).alias("bias"))
    return df.withColumn("reliable", (F.col("within_one") >= RELIABLE).cast("int"))


def calibrated(pairs: DataFrame) -> DataFrame:
    """One row over all criteria, with whether the judge is calibrated."""
    all_ = calibration(pairs.withColumn("criterion", F.lit("all"))).drop("criterion", "reliable")
    return all_.withColumn("calibrated", ((F.col("within_one") >= CALIBRATED) & (F.col("exact") >= EXACT) & (F.abs("bias") <= BIAS)).cast("int"))


def consensus(samples: DataFrame) -> DataFrame:
    """(criterion, n, median, lowest, highest, disagreed) of samples (criterion, actual): they disagree if their range is over 1."""
    span = samples.groupBy("criterion").agg(F.min("actual").alias("lowest"), F.max("actual").alias("highest"))
    return upper_median(samples, ["criterion"], "actual").join(span, "criterion").withColumn("disagreed", (F.col("highest") - F.col("lowest") > 1).cast("int"))


def verdicts(scores: DataFrame) -> DataFrame:
    """(item, score, confidence, verdict) of rows (item, score 0 to 1, weight, confidence): weighted mean; too little confidence asks for a human."""
    df = scores.groupBy("item").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("s"), F.avg("confidence").alias("c"))
    verdict = F.when(F.col("c") < SURE, "needs-human-review").when(F.col("s") >= PASS, "pass").otherwise("fail")
    return df.select("item", F.round("s", 6).alias("score"), F.round("c", 6).alias("confidence"), verdict.alias("verdict"))


def parse_responses(responses: DataFrame, item: str, text: str = "response") -> DataFrame:
    """(item, criterion, score, confidence, n_evidence) of the scores in judges' JSON answers, wherever it stands in the text: bare, in a fenced block, or after prose.

    A score that is no number counts as 0, a confidence that is none as 0.5, others are held between 0 and 1. Answers without a list of scores give no rows: see `unreadable`.
    """
    score = "STRUCT<criterionId: STRING, score: STRING, confidence: STRING, evidence: ARRAY<STRING>>"
    found = F.from_json(_json_of(F.coalesce(F.col(text), F.lit(""))), f"scores ARRAY<{score}>")
    each = responses.select(item, F.explode(found["scores"]).alias("s")).where("s.criterionId is not null")
    number = lambda c, default: F.coalesce(F.col(c).try_cast("double"), F.lit(default))
    return each.select(item, F.col("s.criterionId").alias("criterion"), number("s.score", 0.0).alias("score"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number("s.confidence", 0.5))).alias("confidence"), F.greatest(F.size("s.evidence"), F.lit(0)).alias("n_evidence"))


def unreadable(responses: DataFrame, item: str, text: str = "response") -> DataFrame:
    """(item, problem) of answers without JSON, or without a list of scores in it."""
    found = _json_of(F.coalesce(F.col(text), F.lit("")))
    parsed = F.try_parse_json(found)
    listed = F.from_json(found, "scores ARRAY<STRING>")["scores"].isNotNull()
    problem = F.when(found.isNull(), "no JSON").when(parsed.isNull(), "not valid JSON").when(~listed, "no list of scores")
    return responses.select(item, problem.alias("problem")).where("problem is not null")


def balanced(text: str) -> str | None:
    """The first JSON object or array of a text that begins with one, up to its closing bracket; brackets inside strings do not count."""
    pairs = {"{": "}", "[": "]"}
    if text[:1] not in pairs:
        return None
    opened, closed, depth = text[0], pairs[text[0]], 0
    for token in _TOKENS.finditer(text):
        depth += (token[0] == opened) - (token[0] == closed)
        if not depth:
            return text[: token.end()]
    return None


#: Strings (which may hold brackets), or brackets.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
_FENCE = re.compile(P.JSON_FENCE)


def json_of(text: str) -> str | None:
    """The JSON in a judge's answer: the text itself, the first fenced block, or the first object."""
    if (whole := balanced(text.strip())) is not None:
        return whole
    if (fence := _FENCE.search(text)) and fence[1]:
        return fence[1].strip()
    at = text.find("{")
    return balanced(text[at:]) if at >= 0 else None


@F.pandas_udf(StringType())
def _json_of(text: pd.Series) -> pd.Series:
    return text.map(json_of)


def rubric_scores(parsed: DataFrame, rubric: DataFrame, item: str) -> DataFrame:
    """(item, criterion, score 0 to 1, weight, confidence) of every criterion of a rubric (criterion, weight, low, high) for each item: scores are held inside their levels; one that the judge left out counts as 0 without confidence. Of several the first by score counts.
    Others are ignored."""
    own = parsed.groupBy(item, "criterion").agg(F.min(F.struct("score", "confidence")).alias("s"))
    criteria = rubric.select("criterion", "weight", "low", "high").limit(MOST_CRITERIA + 1).collect()
    if len(criteria) > MOST_CRITERIA:
        raise ValueError(f"a rubric of more than {MOST_CRITERIA} criteria")
    kind = "array<struct<criterion:string,weight:double,low:double,high:double>>"
    listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in c.asDict().items())) for c in criteria)).cast(kind) if criteria else F.array().cast(kind)
    every = parsed.select(item).distinct().select(item, F.explode(listed).alias("c")).select(item, "c.*")
    held = F.greatest("low", F.least("high", "s.score"))
    share = F.when(F.col("s").isNull() | (F.col("high") <= F.col("low")), 0.0).otherwise((held - F.col("low")) / (F.col("high") - F.col("low")))
    return every.join(own, [item, "criterion"], "left").select(item, "criterion", share.alias("score"), "weight", F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"))


def weighted_verdicts(scores: DataFrame, item: str, passing: float = PASS, sure: float = SURE) -> DataFrame:
    """(item, score, confidence, verdict) from `rubric_scores`, both means weighted."""
    mean = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight")
    df = scores.groupBy(item).agg(mean("score").alias("s"), mean("confidence").alias("c"))
    verdict = F.when(F.col("c") < sure, "needs-human-review").when(F.col("s") >= passing, "pass").otherwise("fail")
    return df.select(item, F.round("s", 6).alias("score"), F.round("c", 6).alias("confidence"), verdict.alias("verdict"))


def calibration_drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(criterion, bias_delta, mae_delta, drifted) of criteria in both sets of pairs (criterion, expected, actual), and a row with criterion null for all pairs together (there mae_delta is that of the share within one)."""
    d = F.col("actual") - F.col("expected")

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.rollup("criterion").agg(F.avg(d).alias(f"{name}_bias"), F.avg(F.abs(d)).alias(f"{name}_mae"), F.avg((F.abs(d) <= 1).cast("int")).alias(f"{name}_near"))

    a, b = measured(baseline, "was"), measured(current, "now").withColumnRenamed("criterion", "c")
    both = b.join(a, F.col("c").eqNullSafe(F.col("criterion")))
    bias = F.col("now_bias") - F.col("was_bias")
    other = F.when(F.col("c").isNull(), F.col("now_near") - F.col("was_near")).otherwise(F.col("now_mae") - F.col("was_mae"))
    return both.select(F.col("c").alias("criterion"), F.round(bias, 6).alias("bias_delta"), F.round(other, 6).alias("mae_delta"), ((F.abs(bias) > threshold) | (F.abs(other) > threshold)).cast("int").alias("drifted"))


def rubric_of(levels: DataFrame) -> DataFrame:
    """(criterion, weight, low, high) from the levels of a rubric's criteria (criterion, weight, level): weights made to sum to 1, those not given counting as 1."""
    own = levels.groupBy("criterion").agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight"), F.min("level").cast("double").alias("low"), F.max("level").cast("double").alias("high"))
    return own.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def rubric_problems(levels: DataFrame) -> DataFrame:
    """(criterion, problem) of criteria that cannot be judged by: without a name, with fewer than two levels, with a level twice, or with a weight that is not positive."""
    per = levels.groupBy("criterion").agg(F.count("level").alias("n"), F.count_distinct("level").alias("distinct"), F.min("weight").alias("weight"))
    rules = {"has no name": F.coalesce(F.trim("criterion"), F.lit("")) == "", "has fewer than two levels": F.col("n") < 2, "has a level twice": F.col("distinct") < F.col("n"), "has no positive weight": F.col("weight") <= 0}
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return per.select("criterion", F.explode(found).alias("problem"))


def verdict_assertions(verdicts: DataFrame, scores: DataFrame, item: str, least: float = PASS, sure: float = SURE) -> DataFrame:
    """(item, passes, confident, meets_all, worst) of `weighted_verdicts` and `rubric_scores`: the verdict is pass, the confidence is enough, every criterion scores `least` or more, and the criterion that scores worst."""
    per = scores.groupBy(item).agg(F.min("score").alias("low"), F.min(F.struct("score", "criterion")).alias("w"))
    return verdicts.join(per, item).select(item, (F.col("verdict") == "pass").alias("passes"), (F.col("confidence") >= sure).alias("confident"), (F.col("low") >= least).alias("meets_all"), F.col("w.criterion").alias("worst"))
