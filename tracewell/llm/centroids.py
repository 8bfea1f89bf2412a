"""Operator 11. Exact integer k-means with partial-distance search.

Vectors become integers (floor of SCALE times each component), so that distances, sums and centroids are exact and do not depend on how Spark deals out rows. Every
search takes the dimensions in descending order of variance: a first block of them for all centroids at once, then, from the most promising centroid on, block after block for
the pairs that are still open. A centroid is abandoned for a vector as soon as its partial sum is strictly above the vector's best whole distance; a pair that is only equal
goes on, and whoever goes on finishes all dimensions, so ties are decided by whole distances: the smaller number wins.

Each round is one pass over the written integer vectors. Tasks hold their clusters' sums and send one row a cluster; the driver gets k rows of sums and sends k centroids.

A vector is kept if it has exactly `dims` components, none of them null, NaN or infinite; a null vector is not. Components of 2^21 and more could take distances beyond a long and raise ValueError
instead of wrapping around. A null id hashes as the empty text and stays null in the result; of rows that share an id, the one with the smaller integer vector counts as earlier, and rows equal
in both are each a vector (and may each start a centroid). With fewer than k vectors each of them starts a centroid; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.llm.common import materialise, quoted

#: Fixed values of the query: components, factor, centroids, rounds.
DIMS, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Dimensions added between two looks at what is still open.
BLOCK = 8
#: The largest integer component: 64 squares of twice of it, summed, stay below 2^63.
MOST = 1 << 27


def quantised(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v array<int>) of the vectors that are kept."""
    slim = df.select(quoted(id_column)[0].alias("id"), quoted(vector)[0].cast("array<double>").alias("v"))
    most = MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            of_size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dims
            batch = batch.filter(pa.array(of_size))
            # a null component is NaN here and goes with the others
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            fine = np.isfinite(flat).all(axis=1)
            whole = np.floor(flat[fine] * scale)
            if np.abs(whole).max(initial=0) > most:
                raise ValueError(f"components of {most // scale} and more take distances beyond a long")
            offsets = np.arange(0, dims * len(whole) + 1, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(fine)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.ravel().astype(np.int32)))], names=["id", "v"])

    return slim.mapInArrow(run, StructType([slim.schema["id"], *StructType.fromDDL("v array<int>").fields]))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of `vectors` its nearest centroid (ties: the smaller number) and the squared distance; and how many pairs were followed through all dimensions."""
    n, dims = vectors.shape
    v, c = np.ascontiguousarray(vectors[:, order]), np.ascontiguousarray(centroids[:, order])
    head = min(BLOCK, dims)
    first = np.stack([((v[:, :head] - row[:head]) ** 2).sum(axis=1) for row in c], axis=1)
    cluster = first.argmin(axis=1)
    best = first[np.arange(n), cluster] + ((v[:, head:] - c[cluster, head:]) ** 2).sum(axis=1)
    guess, finished = cluster.copy(), n
    for k in range(len(c)):
        open_rows = np.flatnonzero((guess != k) & (first[:, k] <= best))
        partial = first[open_rows, k]
        for d in range(head, dims, BLOCK):
            partial = partial + ((v[open_rows, d : d + BLOCK] - c[k, d : d + BLOCK]) ** 2).sum(axis=1)
            going = partial <= best[open_rows]
            open_rows, partial = open_rows[going], partial[going]
            if not len(open_rows):
                break
        finished += len(open_rows)
        wins = (partial < best[open_rows]) | (k < cluster[open_rows])
        cluster[open_rows[wins]], best[open_rows[wins]] = k, partial[wins]
    return cluster, best, finished


def _spread(vectors: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by descending variance. Sums of floats serve: the order is only one of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            rows = _rows(batch, dims).astype(np.float64)
            n, s, q = n + len(rows), s + rows.sum(axis=0), q + (rows * rows).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([x]) for x in (*s, *q))], names=["n", *(f"s{i}" for i in range(dims)), *(f"q{i}" for i in range(dims))])

    names = [f"{x}{i} double" for x in "sq" for i in range(dims)]
    parts = vectors.select("v").mapInArrow(run, ", ".join(["n long", *names]))
    total = np.array([float(x or 0) for x in parts.agg(*(F.sum(c) for c in parts.columns)).first()])
    n, s, q = max(total[0], 1.0), total[1 : dims + 1], total[dims + 1 :]
    return np.argsort(-(q / n - (s / n) ** 2), kind="stable")


def _moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of each one's vectors; empty ones stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            rows = _rows(batch, dims)
            cluster = nearest(rows, centroids, order)[0] if len(rows) else np.zeros(0, np.int64)
            count += np.bincount(cluster, minlength=k)
            for i in np.unique(cluster):
                total[i] += rows[cluster == i].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(dims))], names=["cluster", "n", *(f"s{i}" for i in range(dims))])

    parts = vectors.select("v").mapInArrow(run, ", ".join(["cluster int", "n long", *(f"s{i} long" for i in range(dims))]))
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)))
    out = centroids.copy()
    for row in sums.collect():  # k rows at most
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return out


def kmeans(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, salt: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance) of every kept vector after `rounds` rounds, as a written table, and the final centroids. Centroids start as the k vectors with the least SHA-256 of the salt and the id."""
    vectors = materialise(quantised(df, id_column, vector, dims, scale), "op11-vectors")
    order = _spread(vectors, dims)
    by_hash = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = vectors.orderBy(by_hash, "v").select("v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(len(start), dims)
    for _ in range(rounds if len(start) else 0):
        centroids = _moved(vectors, centroids, order)
    return materialise(_assigned(vectors, centroids, order), "op11-assigned"), centroids


def _assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch, len(order))
            if len(rows):
                cluster, distance, _ = nearest(rows, centroids, order)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "v", "cluster", "distance"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, *StructType.fromDDL("cluster int, distance long").fields]))


def clusters(df: DataFrame, id_column: str = "vec_id", **options) -> DataFrame:
    """One row per kept vector: its id, cluster, squared distance, its cluster's and the whole inertia, and a digest of its final centroid."""
    assigned, centroids = kmeans(df, id_column, **options)
    digests = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in centroids]
    named = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests else F.lit(None).cast("string")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    # one row a cluster
    sums = assigned.groupBy("cluster").agg(exact("distance").alias("part")).select(F.col("cluster").alias("of"), F.col("part").cast("long").alias("cluster_inertia"), F.sum("part").over(Window.partitionBy()).cast("long").alias("inertia"))
    both = assigned.join(F.broadcast(sums), F.col("cluster") == F.col("of"))
    return both.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", named.alias("centroid_sha256"))

