"""How far a verdict can be trusted: six signals over the criteria of a judgement, weighed into one confidence and a recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of the signals and thresholds.
WEIGHT = {"self_reported": 0.25, "evidence": 0.20, "consistency": 0.20, "boundary": 0.15, "coverage": 0.10, "reasoning": 0.10}
PASS, MARGIN, SURE, MAX_RANGE, MIN_SELF, MAX_FLAGS, MIN_REASON = 0.6, 0.1, 0.6, 0.6, 0.4, 3, 20
# Reasons that say nothing.
BOILERPLATE = [
    "(?i)^(good|bad|okay|fine|acceptable|adequate|sufficient|satisfactory)\\.?$",
    "(?i)^the (output|response|answer) (is|was) (good|bad|okay|fine|adequate)\\.?$",
    "(?i)^(meets|does not meet) (expectations|requirements)\\.?$",
    "(?i)^(no|n/a|none|nothing)\\.?$",
    "(?i)^see above\\.?$",
]


def signals(judged: DataFrame, expected: int) -> DataFrame:
    """(item, six signals, six flags as one count and two flags by name) of rows (item, score 0 to 1, weight, confidence, n_evidence, reasoning), one a criterion; `expected` criteria make a full judgement.

    All signals are aggregates, so a judgement's criteria are combined before the shuffle.
    """
    reason = F.trim(F.coalesce("reasoning", F.lit("")))
    says = F.length(reason) >= MIN_REASON
    for p in BOILERPLATE:
        says &= ~reason.rlike(p)
    a = judged.groupBy("item").agg(
        F.count("*").alias("n"),
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("overall"),
        (F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight")).alias("self_reported"),
        F.avg((F.coalesce("n_evidence", F.lit(0)) >= 1).cast("int")).alias("evidenced"),
        F.avg(F.coalesce("n_evidence", F.lit(0))).alias("mean_evidence"),
        (F.max("score") - F.min("score")).alias("range"),
        F.stddev_pop("score").alias("sd"),
        F.count_if(F.col("score").isNotNull() & (reason != "")).alias("scored"),
        F.avg(says.cast("int")).alias("reasoning"),
    )
    near = F.abs(F.round(F.col("overall") - PASS, 6))
    consistency = F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), 1 - F.col("range") / MAX_RANGE) - 0.3 * F.greatest(F.lit(0.0), (F.col("sd") - 0.15) / 0.3)))
    a = a.withColumn("evidence", F.least(F.lit(1.0), F.col("evidenced") + F.least(F.lit(0.2), F.col("mean_evidence") * 0.05)))
    a = a.withColumn("consistency", consistency).withColumn("boundary", F.when(near < MARGIN, near / MARGIN).otherwise(1.0)).withColumn("coverage", F.col("scored") / expected)
    flags = {"self_reported": F.round("self_reported", 6) < MIN_SELF, "evidence": F.col("evidenced") < 0.5, "consistency": (F.col("n") >= 2) & (F.round("range", 6) > MAX_RANGE), "boundary": near < MARGIN, "coverage": F.round("coverage", 6) < 0.8, "reasoning": F.col("reasoning") < 0.5}
    return a.select("item", "overall", *WEIGHT, sum((f.cast("int") for f in flags.values()), F.lit(0)).alias("n_flags"), flags["boundary"].alias("borderline"), flags["evidence"].alias("low_evidence"))


def assess(judged: DataFrame, expected: int) -> DataFrame:
    """(item, confidence, n_flags, recommendation, trustworthy, verdict): verdicts that cannot be trusted go to human review."""
    confidence = F.round(sum((F.col(k) * w for k, w in WEIGHT.items()), F.lit(1e-9)), 6)  # the small term settles ties of sums in another order
    s = signals(judged, expected).withColumn("confidence", confidence)
    recommendation = F.when(F.col("n_flags") >= MAX_FLAGS, "contradictory").when(F.col("confidence") < SURE, "needs-review").when(F.col("borderline"), "borderline").when(F.col("low_evidence"), "low-evidence").otherwise("trust-verdict")
    s = s.withColumn("recommendation", recommendation)
    trust = (F.col("recommendation") == "trust-verdict") | ((F.col("recommendation") == "low-evidence") & (F.col("confidence") >= SURE + 0.1))
    verdict = F.when(~trust, "needs-human-review").when(F.round("overall", 6) >= PASS, "pass").otherwise("fail")
    return s.select("item", "confidence", "n_flags", "recommendation", trust.cast("int").alias("trustworthy"), verdict.alias("verdict"))
