"""Operator 13. Shards by best-fit-decreasing bin packing of indivisible groups.

A document's size is its text's UTF-8 bytes and HEADER more. Documents with equal texts are one group, which stays in one shard; null and empty texts are one group. Groups by falling size enter the bin with the least remaining
capacity that still takes them; the bins hang in a balanced (AA) tree by remaining capacity, so a step costs the logarithm of the number of bins. The law is `bytes`: a group larger than a fair share of what is left gets a
shard of its own, and for the others the least capacity is sought with which best-fit-decreasing needs no more than the shards left.

At scale the groups are packed twice. Groups of less than a GRAIN-th of a shard are dealt into buckets by their digest, and each bucket packs its own, streamed by falling size, into parcels of that capacity; bins that nothing more
can enter are given out at once, so a task holds open bins only. Parcels are indivisible then, and enter the shards together with the larger groups: at most (4 / 3 + 4) * GRAIN * n_shards of both and one parcel a bucket,
whatever the size of the corpus, which is what the driver packs. Shards differ by a part of the smallest parcels.

Only digests and sizes are shuffled, never texts. A hot group is one row of sizes after partial sums; its rows get their shard through a join that adaptive execution splits, and their slots by
prefix sums over ranges of a hash-random key, so no task holds a shard. Slots are hash-random in a shard (ties: doc_id as text; rows equal in all are interchangeable). Nulls in doc_id stay; an
empty table gives an empty result; other columns are ignored here and kept by `sharded_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialise, quoted, scratch_dir, shuffle_partitions, unpacked

#: Fixed values of the query: shards, and bytes that each document takes besides its text.
N_SHARDS, HEADER = 40, 16
#: Parcels of a shard, steps of the search for the least capacity, rows aimed at in a range of slots, and the most ranges of a shard.
GRAIN, STEPS, RANGE_ROWS, MAX_RANGE_BITS = 64, 40, 4096, 16


class Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.level, self.left, self.right = key, 1, None, None


def _skew(t: Node | None) -> Node | None:
    if t and t.left and t.left.level == t.level:
        up = t.left
        t.left, up.right = up.right, t
        return up
    return t


def _split(t: Node | None) -> Node | None:
    if t and t.right and t.right.right and t.level == t.right.right.level:
        up = t.right
        t.right, up.left = up.left, t
        up.level += 1
        return up
    return t


def _inserted(t: Node | None, key: tuple[int, int]) -> Node:
    if t is None:
        return Node(key)
    if key < t.key:
        t.left = _inserted(t.left, key)
    else:
        t.right = _inserted(t.right, key)
    return _split(_skew(t))


def _removed(t: Node | None, key: tuple[int, int]) -> Node | None:
    if t is None:
        return None
    if key == t.key and not (t.left and t.right):
        return t.left or t.right
    if key < t.key:
        t.left = _removed(t.left, key)
    elif key > t.key:
        t.right = _removed(t.right, key)
    else:
        heir = t.right
        while heir.left:
            heir = heir.left
        t.key = heir.key
        t.right = _removed(t.right, heir.key)
    low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
    if low < t.level:
        t.level = low
        if t.right and t.right.level > low:
            t.right.level = low
    t = _skew(t)
    t.right = _skew(t.right)
    if t.right:
        t.right.right = _skew(t.right.right)
    t = _split(t)
    t.right = _split(t.right)
    return t


class Bins:
    """Open bins by (remaining capacity, number)."""

    def __init__(self):
        self.root: Node | None = None

    def add(self, room: int, number: int) -> None:
        self.root = _inserted(self.root, (room, number))

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room of at least `size` (of equal ones the first)."""
        t, found = self.root, None
        while t:
            if t.key >= (size, -1):
                t, found = t.left, t.key
            else:
                t = t.right
        if found:
            self.root = _removed(self.root, found)
        return found


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each of the sizes, which fall and are at most `capacity`; None if more than `most` bins are needed."""
    bins, out, n = Bins(), [], 0
    for size in sizes:
        found = bins.take(size)
        if found is None:
            if n == most:
                return None
            found = (capacity, n)
            n += 1
        out.append(found[1])
        if found[0] > size:
            bins.add(found[0] - size, found[1])
    return out


def pack(sizes: list[int], n_shards: int) -> list[int]:
    """The shard of each of the sizes, which fall: those above a fair share of what is left get shards of their own, the rest goes by best fit at the least capacity that is found to serve."""
    left, out = sum(sizes), []
    while len(out) < min(len(sizes), n_shards - 1) and sizes[len(out)] * (n_shards - len(out)) > left:
        left -= sizes[len(out)]
        out.append(len(out))
    alone = len(out)
    rest, bins = sizes[alone:], n_shards - alone
    if not rest:
        return out
    # best fit leaves at most one bin less than half full, so twice the fair share (or the largest) always serves
    low, high = max(rest[0], -(-left // bins)), max(rest[0], 2 * -(-left // bins))
    found = best_fit(rest, high, bins)
    for _ in range(STEPS):
        if low >= high:
            break
        middle = (low + high) // 2
        tried = best_fit(rest, middle, bins)
        if tried is None:
            low = middle + 1
        else:
            found, high = tried, middle
    return out + [alone + i for i in found]


def group_digest(text: str) -> list:
    """128 bits that tell texts apart, as two longs."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("g1"), F.xxhash64(F.lit(1), whole, F.lit(2)).alias("g2")]


def measured(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, g1, g2, key) of every row: key is its place in a hash-random order."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(quoted(id_column)[0].alias("id"), (F.octet_length(whole) + F.lit(HEADER)).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), *group_digest("text"))
    return slim.withColumn("key", F.xxhash64(F.lit(13), F.coalesce(F.col("id").cast("string"), F.lit("\x00")), "g1"))


def _parcels(capacity: int):
    """Packs each bucket's groups (g1, g2, size, bucket; in order of bucket and falling size) into parcels. A bin is given out when the smallest size of all no longer fits into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, bins, n = None, Bins(), 0
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int64)
            for i, (b, size) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("size").to_pylist())):
                if b != bucket:
                    bucket, bins, n = b, Bins(), 0
                found = bins.take(size)
                if found is None:
                    found = (capacity, n)
                    n += 1
                numbers[i] = found[1]
                if found[0] - size >= HEADER:
                    bins.add(found[0] - size, found[1])
            yield pa.RecordBatch.from_arrays([batch.column("g1"), batch.column("g2"), batch.column("size"), batch.column("bucket"), pa.array(numbers)], names=["g1", "g2", "size", "bucket", "parcel"])

    return run


def group_shards(rows: DataFrame, n_shards: int = N_SHARDS, grain: int = GRAIN) -> DataFrame:
    """(g1, g2, shard) of every group of `rows` (g1, g2, size)."""
    groups = materialise(rows.groupBy("g1", "g2").agg(F.sum("size").alias("size")), "op13-groups")
    total, n_groups = groups.agg(F.coalesce(F.sum(F.col("size").cast("decimal(38,0)")), F.lit(0)), F.count("*")).first()
    capacity = max(1, int(total) // (n_shards * grain))
    small = F.col("size") * 4 <= capacity
    # parcels of a few hundred groups or more: a bucket has four parcels' worth of groups, and there is no more than one for each quarter shard of bytes
    n_buckets = max(1, min(n_shards * grain // 4, int(n_groups) // 256))
    dealt = groups.where(small).withColumn("bucket", F.pmod(F.col("g1"), F.lit(n_buckets)).cast("int"))
    dealt = dealt.repartition(min(n_buckets, max(shuffle_partitions(groups), 1)), "bucket").sortWithinPartitions("bucket", F.col("size").desc(), "g1", "g2")
    parcels = materialise(dealt.select("g1", "g2", "size", "bucket").mapInArrow(_parcels(capacity), "g1 long, g2 long, size long, bucket int, parcel long"), "op13-parcels")
    # a bounded number of rows: see the head of the module
    weights = parcels.groupBy("bucket", "parcel").agg(F.sum("size").alias("size")).select("bucket", "parcel", F.lit(None).cast("long").alias("g1"), F.lit(None).cast("long").alias("g2"), "size")
    items = weights.unionByName(groups.where(~small).select(F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("parcel"), "g1", "g2", "size"))
    packed = items.toArrow().sort_by([("size", "descending"), ("bucket", "ascending"), ("parcel", "ascending"), ("g1", "ascending"), ("g2", "ascending")])
    packed = packed.append_column("shard", pa.array(pack(packed.column("size").to_pylist(), n_shards), pa.int32()))
    of_parcels = packed.column("bucket").is_valid()
    at_parcels = rows.sparkSession.createDataFrame(packed.filter(of_parcels).select(["bucket", "parcel", "shard"]))
    at_groups = rows.sparkSession.createDataFrame(packed.filter(pc.invert(of_parcels)).select(["g1", "g2", "shard"]))
    return parcels.join(F.broadcast(at_parcels), ["bucket", "parcel"]).select("g1", "g2", "shard").unionByName(at_groups)


def with_slots(rows: DataFrame) -> DataFrame:
    """rows (shard, key, id ...) with a slot: gapless from 0 in each shard, in the order of the hash-random key, by prefix sums over ranges of keys."""
    bits = min(MAX_RANGE_BITS, max(4, (rows.count() // RANGE_ROWS).bit_length()))
    ranged = rows.withColumn("range", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    parts = ranged.groupBy("shard", "range").agg(F.count("*").alias("part"))
    # a row for each shard and range: their number is bounded
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("shard").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy(F.shiftleft("key", bits).bitwiseXOR(F.lit(-(1 << 63))), F.col("id").cast("string"), "size")
    numbered = ranged.withColumn("place", F.row_number().over(inside))
    both = numbered.join(offsets, (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")))
    return both.withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("long")).drop("s", "r", "offset", "place", "range")


def shards(docs: DataFrame, id_column: str = "doc_id", n_shards: int = N_SHARDS, grain: int = GRAIN) -> DataFrame:
    """One row per document: its id, size, CRC-32 of its text, the law, shard and slot. grown_shard is null: the shards by bytes do not follow from ids."""
    rows = materialise(measured(docs, id_column), "op13-rows")
    placed = materialise(rows.join(group_shards(rows, n_shards, grain), ["g1", "g2"]), "op13-placed")
    return with_slots(placed).select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(docs: DataFrame, id_column: str = "doc_id", n_shards: int = N_SHARDS, grain: int = GRAIN) -> DataFrame:
    """docs' rows, whole, as (shard, row): equal texts together, shards of like bytes."""
    at = group_shards(materialise(measured(docs, id_column), "op13-rows"), n_shards, grain)
    return docs.select(*group_digest("text"), F.struct("*").alias("row")).join(at, ["g1", "g2"]).select("shard", "row")


def write_shards(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", n_shards: int = N_SHARDS, files: int = 4) -> str:
    """Writes docs as Parquet, a folder `shard=N` each, in up to `files` files a shard (a hot one in as many as others), and returns the path. A column of docs named shard is written as it is inside `row`."""
    path = path or scratch_dir(docs.sparkSession, "op13-shards")
    out = sharded_documents(docs, id_column, n_shards).withColumn("part", F.pmod(F.xxhash64(F.col("row").getField(id_column).cast("string")), F.lit(files)))
    out.repartition(n_shards * files, "shard", "part").drop("part").write.partitionBy("shard").parquet(path)
    return path


def read_shard(docs: DataFrame, path: str, shard: int) -> DataFrame:
    """The documents of one written shard, in docs' columns."""
    return docs.sparkSession.read.parquet(path).where(F.col("shard") == shard).select(*unpacked("row", docs))
