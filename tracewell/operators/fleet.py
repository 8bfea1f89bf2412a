"""Fleet operators: check scores, upsert, trends, scorecards. All are grouped aggregations over check scores (worker, run_id, started_ms, check, score, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.sessions import Limits, facts, issue_list, round6

#: Fixed thresholds: pass rates of the grades, and those of trends.
HEALTHY, WATCH = 0.9, 0.6
MIN_POINTS, Z_THRESHOLD, MIN_DELTA, CRITICAL_Z, Z_CAP = 2, 1.0, 0.05, 2.5, 99.0


def check_scores(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Three checks a session: staleness (1 - .5 errors - .15 warnings), verification (1 - .6 errors), completeness (1 - .4 without output - .1 without end)."""
    df = issue_list(facts(events, limits), limits)
    of = lambda severity: F.aggregate("issues", F.lit(0).cast("long"), lambda acc, i: acc + F.when(i["severity"] == severity, i["n"]).otherwise(0))
    df = df.withColumns({"e": of("error"), "w": of("warning")})
    score = lambda e, w, a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - a * e - b * w))
    no_output, no_end = (F.col("n_outputs") == 0).cast("int"), (F.col("has_end") == 0).cast("int")
    status = lambda e, w: F.when(e, "fail").when(w, "warn").otherwise("pass")
    stale = (F.col("e") > 0) | (F.col("e") + F.col("w") >= 3)
    checks = F.array(
        F.struct(F.lit("staleness").alias("check"), score(F.col("e"), F.col("w"), 0.5, 0.15).alias("score"), status(stale, F.col("w") > 0).alias("status")),
        F.struct(F.lit("verification").alias("check"), score(F.least(F.col("n_errors"), F.lit(1)), F.lit(0), 0.6, 0.2).alias("score"), status(F.col("n_errors") > 0, F.lit(False)).alias("status")),
        F.struct(F.lit("completeness").alias("check"), score(no_output, no_end, 0.4, 0.1).alias("score"), status(no_output == 1, no_end == 1).alias("status")),
    )
    return df.select("worker", F.col("session_id").alias("run_id"), F.col("first_ms").alias("started_ms"), F.explode(checks).alias("c")).select("worker", "run_id", "started_ms", "c.check", round6(F.col("c.score")).alias("score"), "c.status")


def run_scores(scores: DataFrame) -> DataFrame:
    """Overall (mean) and worst score of each run, without skipped checks."""
    return _runs(scores).withColumn("overall", round6(F.col("overall")))


def _runs(scores: DataFrame) -> DataFrame:
    on = F.col("status") != "skip"
    return scores.groupBy("worker", "run_id").agg(F.avg(F.when(on, F.col("score"))).alias("overall"), F.min(F.when(on, F.col("score"))).alias("worst"), F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "warn").alias("warns"), F.count_if(on).alias("scored"))


def upsert_latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last version of each key, null versions first. Versions are compared before the shuffle, so a key with many of them sends one from each task."""
    last = F.max(F.struct(*version, F.struct(*rows.columns).alias("row"))).alias("top")
    return rows.groupBy(*keys).agg(last).select(*(F.col("top.row").getField(c).alias(c) for c in rows.columns))


#: Fixed: metrics of trends and whether more is better.
METRICS = {"score": True, "failRate": False, "durationMs": False}


def metric_rows(scores: DataFrame, metric: str = "score") -> DataFrame:
    """(worker, check, run_id, started_ms, value): a metric of each check that was not skipped; unknown values (null, or a negative duration) are left out."""
    value = {"score": F.col("score"), "failRate": (F.col("status") == "fail").cast("double")}.get(metric)
    if value is None:
        value = F.when(F.col(metric) >= 0, F.col(metric).cast("double")) if metric == "durationMs" else F.col(metric).cast("double")
    return scores.where("status <> 'skip'").select("worker", "check", "run_id", "started_ms", value.alias("value")).where("value is not null and not isnan(value)")


def ranked_in_series(rows: DataFrame, series: list[str], by: list[str], bucket: Column) -> DataFrame:
    """rows with `place` (from 1, in the order of `by`) within their series and its length `n`, for series of any length: places inside a bucket of the order are counted in that bucket's task, and the buckets before it add their sizes, so that no task
    holds a series. `bucket` must not fall as `by` rises."""
    df = rows.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*series, "__bucket").orderBy(*by)
    df = df.withColumn("__place", F.row_number().over(inside))
    sizes = df.groupBy(*series, "__bucket").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*series).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__size").over(before), F.lit(0)), "n": F.sum("__size").over(Window.partitionBy(*series))})
    return df.join(sizes.drop("__size"), [*series, "__bucket"]).withColumn("place", F.col("__before") + F.col("__place")).drop("__bucket", "__place", "__before")


#: Buckets of time that series are dealt out by.
DAY_MS = 86_400_000


def trends(scores: DataFrame, metric: str = "score", split: float | str = "half", z_threshold: float = Z_THRESHOLD, min_delta: float = MIN_DELTA, critical_z: float = CRITICAL_Z, warning_z: float | None = None) -> DataFrame:
    """Baseline against recent part of each worker's and check's values: deltas, z, direction, severity. Nothing is rounded before it is compared. The least delta holds for scores only; a fall below warning_z (z_threshold, if none is given) is info."""
    up = METRICS.get(metric, True)
    df = ranked_in_series(metric_rows(scores, metric), ["worker", "check"], ["started_ms", "run_id"], F.floor(F.col("started_ms") / DAY_MS))
    share = F.floor(F.col("n") / 2) if split == "half" else F.floor(F.col("n") * min(max(float(split), 0.0), 1.0) + 0.5)
    recent = F.when(F.col("n") >= 2, F.greatest(F.lit(1), F.least(F.col("n") - 1, share))).otherwise(share)
    late = F.col("place") > F.col("n") - recent
    base, after = F.when(~late, F.col("value")), F.when(late, F.col("value"))
    df = df.groupBy("worker", "check").agg(F.count(base).alias("n_base"), F.count(after).alias("n_recent"), F.avg(base).alias("mean_base"), F.avg(after).alias("mean_recent"), F.stddev_pop(base).alias("sd_base"))
    df = df.withColumn("delta", F.col("mean_recent") - F.col("mean_base"))
    z = F.when(F.col("sd_base") == 0, F.when(F.col("delta") == 0, 0.0).otherwise(F.signum("delta") * Z_CAP)).otherwise(F.greatest(F.lit(-Z_CAP), F.least(F.lit(Z_CAP), F.col("delta") / F.col("sd_base"))))
    df = df.withColumn("z", z)
    enough = (F.col("n_base") >= MIN_POINTS) & (F.col("n_recent") >= MIN_POINTS)
    moved = F.abs("z") >= z_threshold
    moved = moved & (F.abs("delta") >= min_delta) if metric == "score" else moved
    better = F.col("delta") > 0 if up else F.col("delta") < 0
    df = df.withColumn("direction", F.when(~enough, "insufficient-data").when(~moved, "stable").when(better, "improving").otherwise("degrading"))
    severity = F.when(F.col("direction") != "degrading", "none").when(F.abs("z") >= critical_z, "critical").when(F.abs("z") >= (z_threshold if warning_z is None else warning_z), "warning").otherwise("info")
    shown = {c: round6(F.col(c)) for c in ("mean_base", "mean_recent", "sd_base", "delta")} | {"z": F.round("z", 4)}
    return df.withColumn("severity", severity).withColumns(shown)


#: Fixed: order of severities, worst last.
SEVERITIES = ["none", "info", "warning", "critical"]


def worst_first(trend_rows: DataFrame, k: int) -> DataFrame:
    """The k worst trends: by severity, then the size of z, then worker and check."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return trend_rows.orderBy(rank.desc(), F.abs("z").desc_nulls_last(), "worker", "check").limit(k)


def in_dates(rows: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows that started on the dates from first to last (UTC, ends included; None: open)."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("started_ms") / DAY_MS).cast("int"))
    for bound, keep in ((first, lambda b: day >= b), (last, lambda b: day <= b)):
        rows = rows.where(keep(F.lit(bound).cast("date"))) if bound is not None else rows
    return rows


def rolling_days(scores: DataFrame, days: int = 7) -> DataFrame:
    """(worker, check, day, n, mean_score): mean over the days up to each day that has scores, from sums by day."""
    day = F.floor(F.col("started_ms") / DAY_MS).cast("long")
    daily = metric_rows(scores).groupBy("worker", "check", day.alias("day")).agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    window = Window.partitionBy("worker", "check").orderBy("day").rangeBetween(-(days - 1), 0)
    return daily.select("worker", "check", "day", F.sum("c").over(window).alias("n"), round6(F.sum("s").over(window) / F.sum("c").over(window)).alias("mean_score"))


def worker_trends(trend_rows: DataFrame) -> DataFrame:
    """Each worker's net direction."""
    df = trend_rows.groupBy("worker").agg(F.count_if(F.col("direction") == "degrading").alias("degrading"), F.count_if(F.col("direction") == "improving").alias("improving"), F.max((F.col("severity") == "critical").cast("int")).alias("critical"))
    return df.withColumn("net", F.when(F.col("degrading") > F.col("improving"), "degrading").when(F.col("degrading") < F.col("improving"), "improving").otherwise("stable"))


def scorecard(scores: DataFrame) -> DataFrame:
    """Pass rate, mean and grade of each worker, with its trend."""
    runs = _runs(scores)
    df = runs.groupBy("worker").agg(F.count("*").alias("runs"), round6(F.avg((F.col("fails") == 0).cast("int"))).alias("pass_rate"), round6(F.avg("overall")).alias("mean_score"))
    df = df.join(worker_trends(trends(scores)), "worker", "left")
    base = F.when(F.col("pass_rate").isNull(), "no-data").when(F.col("pass_rate") >= HEALTHY, "healthy").when(F.col("pass_rate") >= WATCH, "watch").otherwise("at-risk")
    falling = F.coalesce(F.col("net"), F.lit("stable")) == "degrading"
    grade = F.when(falling & (F.col("critical") == 1), F.when(base == "at-risk", "critical").otherwise("at-risk")).when(falling & (base == "healthy"), "watch").otherwise(base)
    return df.select("worker", "runs", "pass_rate", "mean_score", F.coalesce("net", F.lit("stable")).alias("trend"), grade.alias("grade"))


def check_breakdown(scores: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return scores.where("status <> 'skip'").groupBy("worker", "check").agg(round6(F.avg("score")).alias("mean_score"), F.count("*").alias("runs"), count("fail").alias("fails"), count("warn").alias("warns"), count("pass").alias("passes"))


def failure_categories(scores: DataFrame) -> DataFrame:
    return scores.where("status = 'fail'").groupBy("check").agg(F.count("*").alias("fails"))


def fleet_rollup(scores: DataFrame) -> DataFrame:
    """Mean over runs for each worker, and for the fleet (worker null)."""
    return _runs(scores).rollup("worker").agg(F.count("*").alias("runs"), round6(F.avg("overall")).alias("mean_score"))


def grade_histogram(cards: DataFrame) -> DataFrame:
    return cards.groupBy("grade").agg(F.count("*").alias("workers"))
