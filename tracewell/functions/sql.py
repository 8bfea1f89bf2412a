"""Functions for spark.sql: `register(spark)` makes the library's text metrics, generators and checks callable by name.

Scalar metrics are SQL functions, which the optimizer takes apart like any expression. Generators are Arrow functions that give arrays, to be exploded in a LATERAL VIEW: a batch of texts at a time. `retry_runs` is a table function over a
table argument, dealt out by session and read in order: it keeps one run at a time, however long the session is. `custom` puts a check of one's own beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from tracewell.functions import drift, grounding

#: Name, parameters, result and body of each scalar function.
SCALARS = {
    "tw_tokens": ("x STRING", "BIGINT", "CAST(ceil(length(coalesce(x, '')) / 4) AS BIGINT)"),
    "tw_words": ("x STRING", "ARRAY<STRING>", r"regexp_extract_all(coalesce(x, ''), '[^ \\t\\n\\r\\f\\x0B]+', 0)"),
    "tw_word_count": ("x STRING", "BIGINT", "CAST(size(tw_words(x)) AS BIGINT)"),
    "tw_slug": ("x STRING", "STRING", "regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-'), '^-+|-+$', '')"),
    "tw_jaccard": ("x STRING, y STRING", "DOUBLE", "CASE WHEN size(tw_words(x)) + size(tw_words(y)) = 0 THEN 1.0D ELSE round(size(array_intersect(tw_words(lower(x)), tw_words(lower(y)))) / size(array_union(tw_words(lower(x)), tw_words(lower(y)))), 6) END"),
    "tw_keyword_coverage": ("x STRING, words ARRAY<STRING>", "DOUBLE", "CASE WHEN size(words) = 0 THEN 1.0D ELSE round(size(filter(words, w -> contains(lower(x), lower(w)))) / size(words), 6) END"),
    "tw_duration": (
        "ms DOUBLE",
        "STRING",
        "CASE WHEN ms < 1000 THEN concat(CAST(CAST(round(ms) AS BIGINT) AS STRING), 'ms') WHEN ms < 60000 THEN concat(format_string('%.1f', ms / 1000), 's') WHEN ms < 3600000 THEN concat(format_string('%.1f', ms / 60000), 'm') ELSE concat(format_string('%.1f', ms / 3600000), 'h') END",
    ),
}


@F.arrow_udf(ArrayType(StructType().add("text", StringType()).add("label", StringType())))
def _segments(texts):
    import pyarrow as pa

    return pa.array([drift.cut_segments(t) for t in texts.to_pylist()], pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())])))


@F.arrow_udf(grounding._CLAIMS)
def _claims(texts):
    return grounding._extracted(texts, None, 0.5, False, float("inf"))


@F.udtf(returnType="session_id STRING, tool STRING, first_pos BIGINT, length BIGINT, failed_first BOOLEAN, failures BIGINT")
class RetryRuns:
    """Runs of calls of one tool after another, out of rows (session_id, pos, tool, is_error) of a session in order."""

    def __init__(self):
        self.run = None

    def eval(self, row) -> Iterator[tuple]:
        if self.run and self.run[1] == row["tool"]:
            self.run[3] += 1
            self.run[5] += int(row["is_error"])
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row["session_id"], row["tool"], row["pos"], 1, bool(row["is_error"]), int(row["is_error"])]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    """All functions of this module, for the session."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("tw_segments", _segments)
    spark.udf.register("tw_claims", _claims)
    spark.udtf.register("tw_retry_runs", RetryRuns)


def custom(spark: SparkSession, name: str, check: Callable[[pd.Series], pd.Series]) -> Callable[[Column | str], Column]:
    """A check of one's own, over a batch of texts (null: empty) at a time, as a column function and as SQL function `name`. A check that raises fails the query."""

    def run(texts: pd.Series) -> pd.Series:
        return check(texts.fillna("")).astype(bool)

    made = F.pandas_udf(run, BooleanType())
    spark.udf.register(name, made)
    return made


def retry_runs(outcomes: DataFrame) -> DataFrame:
    """(session_id, tool, first_pos, length, failed_first, failures) of tool outcomes (session_id, pos, tool, is_error), by the table function."""
    register(outcomes.sparkSession)
    slim = outcomes.select("session_id", F.col("pos").cast("long").alias("pos"), F.col("tool").cast("string").alias("tool"), "is_error")
    return outcomes.sparkSession.sql("SELECT * FROM tw_retry_runs(TABLE(SELECT * FROM {o}) PARTITION BY session_id ORDER BY pos)", o=slim)
