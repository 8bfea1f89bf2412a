"""What a run reports of itself against what its orchestrator recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What an exit status says of a run.
OUTCOME = {"ok": "pass", "error": "fail", "timeout": "fail", "killed": "fail", "running": "running"}


def verification(runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """(run_id, worker, score, status, n_errors, n_warnings).

    runs: (run_id, worker, outcome, reported_ms); metadata: (run_id, worker, exit_status, exit_code, measured_ms), where a row may
    name the run, worker and run, or only the worker (the other null), and the most exact one counts. Runs without any are skipped
    with a score of 0. Each way of matching is an equi-join; metadata is reduced to one row a key before it.
    """
    record = F.struct("exit_status", "exit_code", "measured_ms")

    def best(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min_by(record, F.struct("exit_status", "exit_code", "measured_ms")).alias(name))

    by_run = best(metadata.where("run_id is not null and worker is null"), ["run_id"], "_1")
    by_both = best(metadata.where("run_id is not null and worker is not null"), ["run_id", "worker"], "_2")
    by_worker = best(metadata.where("run_id is null and worker is not null"), ["worker"], "_3")
    df = runs.join(by_run, "run_id", "left").join(by_both, ["run_id", "worker"], "left").join(by_worker, "worker", "left").withColumn("_m", F.coalesce("_1", "_2", "_3"))
    by_status = F.lit(None).cast("string")
    for status, outcome in OUTCOME.items():
        by_status = F.when(F.col("_m.exit_status") == status, outcome).otherwise(by_status)
    truth = F.coalesce(by_status, F.when(F.col("_m.exit_code") == 0, "pass").when(F.col("_m.exit_code").isNotNull(), "fail"), F.lit("unknown"))
    said, ms, real = F.col("outcome"), F.col("reported_ms"), F.col("_m.measured_ms")
    claims = said.isin("pass", "fail", "partial")
    off = (ms > 0) & (F.abs(ms - real) > 60_000) & ((real == 0) | ~(ms / F.nullif(real, F.lit(0))).between(0.66, 1.5))
    as_int = lambda rule: F.coalesce(rule, F.lit(False)).cast("int")
    errors = as_int((said == "pass") & (truth == "fail"))
    warnings = as_int(claims & (truth == "running")) + as_int((said == "fail") & (truth == "pass")) + as_int(off)
    none = F.col("_m").isNull()
    score = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.6 * errors - 0.2 * warnings))
    status = F.when(none, "skip").when(errors > 0, "fail").when(warnings > 0, "warn").otherwise("pass")
    return df.select("run_id", "worker", F.round(score, 6).alias("score"), status.alias("status"), F.when(none, 0).otherwise(errors).alias("n_errors"), F.when(none, 0).otherwise(warnings).alias("n_warnings"))
