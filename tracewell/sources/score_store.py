"""The store of check scores: JSON lines, apart for each worker, read, upserted and written by commits (sources/commits.py). Files <worker>/scores.jsonl that others wrote count for workers that no commit has touched yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.commits import Files, Store

KEY = ["worker", "runId", "check"]
#: What a row must have to be a score.
SCORE = "worker STRING, runId STRING, check STRING, score DOUBLE, status STRING, startedAt STRING, startedAtMs LONG, detail STRING"
STATUSES = ["pass", "warn", "fail", "skip"]


def parse_scores(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of SCORE from JSON lines; lines that do not parse, or that lack a key, a score or a known status, are left out."""
    r = F.from_json(F.trim(column), SCORE)
    df = lines.select(r.alias("r")).select("r.*")
    return df.where(F.col("status").isin(*STATUSES)).dropna(subset=[*KEY, "score"])


def _files_of_others(spark: SparkSession, root: str) -> DataFrame:
    files = Files(spark, root)
    paths = [f"{root}/{name}/scores.jsonl" for name in files.names("") if name not in ("data", "log") and files.fs.exists(files.path(f"{name}/scores.jsonl"))]
    return parse_scores(spark.read.text(paths)) if paths else spark.createDataFrame([], SCORE)


def store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, SCORE, lambda: F.col("worker"), KEY, ["startedAtMs"], parse_scores, _files_of_others)


def read_scores(spark: SparkSession, root: str, workers: list[str] | None = None) -> DataFrame:
    """All scores of the store, or those of some workers; none if there is no store."""
    df = store(spark, root).read()
    return df if workers is None else df.where(F.col("worker").isin(*workers))


def write_scores(incoming: DataFrame, root: str, mode: str = "upsert") -> dict[str, int]:
    """Write the store with these rows in it; how many were added, how many replaced, and the total. Only the workers of the rows are written."""
    at = store(incoming.sparkSession, root)
    done = at.write(incoming, mode)
    return {"added": done["added"], "replaced": done["replaced"], "total": at.read().count()}
