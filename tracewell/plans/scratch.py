"""Folders for stores and tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, local mode (tests) gets a temporary one, and a cluster an error: its machines share no such folder."""
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {key} to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set(key, base)
    return f"{base}/tracewell/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is made once, however often it is used, and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
