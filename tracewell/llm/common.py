"""Helpers shared by the training-data operators: scratch tables, Arrow text blocks, vectorised word spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Bytes of text that a kernel holds at once; longer texts make a block of their own.
BLOCK_BYTES = 2 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir. Where that is unset, local mode (tests) gets a temporary one, and a cluster an error: its machines share no such folder."""
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {key} to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set(key, base)
    return f"{base}/tracewell/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(*names: str) -> list[Column]:
    """Columns by their names, whatever characters those hold."""
    return [F.col(f"`{name.replace('`', '``')}`") for name in names]


def numbered(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """docs with the columns in `keep` as k0, k1 ..., and text as a string under the name of `text`, so that no name clashes with a kernel's; the names to carry through the kernel; and the columns that bring the old names back."""
    twice = "text" in keep and docs.schema["text"].dataType != StringType()
    places = {c: "text" if c == "text" and not twice else f"k{i}" for i, c in enumerate(keep)}
    slim = docs.select(*(quoted(c)[0].alias(k) for c, k in places.items() if k != "text"), F.col("text").cast("string").alias("text"))
    return slim, list(places.values()), [F.col(k).alias(c) for c, k in places.items()]


def unpacked(row: str, docs: DataFrame) -> list[Column]:
    """docs' columns out of a struct of them."""
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def fields(df: DataFrame, names: list[str], more: str = "") -> StructType:
    """The schema of some of df's columns, and of more columns (as DDL)."""
    return StructType([df.schema[c] for c in names] + (StructType.fromDDL(more).fields if more else []))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and len + 1 offsets into them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts take about `limit` bytes, one row at least."""
    if not batch.num_rows:
        return
    ends = text_buffer(batch.column(text))[1][1:]
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_text(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """Run a vectorised kernel over blocks of rows inside the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text):
                yield kernel(block)

    return df.mapInArrow(run, schema)


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the maximal runs of non-separators, and len(offsets) offsets of each text into them."""
    inside = ~separators[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray = SPACES) -> pa.Array:
    """The words as an Arrow binary array. Spans must cover all bytes that are no separators."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~separators[data]]))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: 256 random 64-bit words of the gear hash, made from their index.
GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD1342543DE82EF95)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), _STEP, np.uint64)) if n else np.ones(1, np.uint64)


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for each of the ascending, disjoint, non-empty segments."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    place = np.arange(firsts[-1] + lengths[-1]) - np.repeat(firsts, lengths)
    taken = values[np.repeat(starts, lengths) + place]
    return mix64(np.add.reduceat(taken * _powers(int(lengths.max()))[place], firsts) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return segment_hash(GEAR[data] if len(data) else np.zeros(0, np.uint64), starts, ends)


def crc32_of(column: str) -> F.Column:
    """CRC-32 of an integer column's decimal text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
