"""Operator 2 (native). Winnowing document fingerprints in DataFrame expressions only.

Words are runs of characters other than ASCII white space. Their hashes roll in windows of K words (a cyclic polynomial: rotate and
xor); of every WINDOW consecutive K-gram hashes the least is kept, the rightmost on ties, together with its position. Guarantee: two texts that share
K + WINDOW - 1 words in a row share a fingerprint. Texts of fewer than K words have one gram, the whole; fewer grams than WINDOW make one window.

Null texts count as empty; a text without words has the empty fingerprint, and two empty fingerprints are alike by 1.0. Rows that share a doc_id are
ordered by their text's hash; rows repeated exactly get equal results. A null doc_id sorts last in descending order. Every other input column is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialise, shuffle_partitions

K = 5
WINDOW = 12
_POSITION_BITS = 30
_LAST = (1 << _POSITION_BITS) - 1
_HASH = (1 << 31) - 1
#: Stands for a null doc_id.
_NO_ID = -(1 << 63)


def _rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _take(array: Column, i: Column, offset: int = 0) -> Column:
    return F.get(array, i + F.lit(offset) if offset else i)


def _packed_grams(hashes: Column) -> Column:
    """For each K-gram: 31 bits of its hash, then 30 bits that fall with its position, so that the least has the rightmost position."""

    def gram(i: Column) -> Column:
        rolled = _rotate(_take(hashes, i), K - 1)
        for j in range(1, K):
            rolled = rolled.bitwiseXOR(_rotate(_take(hashes, i, j), K - 1 - j))
        return F.shiftleft(rolled.bitwiseAND(F.lit(_HASH)), _POSITION_BITS).bitwiseOR(F.lit(_LAST) - i)

    whole = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: _rotate(acc, 1).bitwiseXOR(h))
    short = F.array(F.shiftleft(whole.bitwiseAND(F.lit(_HASH)), _POSITION_BITS).bitwiseOR(F.lit(_LAST).cast("long")))
    return F.when(F.size(hashes) >= K, F.transform(F.sequence(F.lit(0).cast("long"), F.size(hashes).cast("long") - K), gram)).when(F.size(hashes) > 0, short).otherwise(F.array().cast("array<long>"))


def _pairwise_least(array: Column, step: int) -> Column:
    return F.transform(F.slice(array, F.lit(1), F.size(array) - step), lambda x, i: F.least(x, F.get(array, i + F.lit(step))))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: the selected grams of a text column in order of position, packed as by _packed_grams. Columns are added step by step so that
    none is computed twice."""
    steps = [f"__{out}_{i}" for i in range(8)]
    df = df.withColumn(steps[0], F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w)))
    df = df.withColumn(steps[1], _packed_grams(F.col(steps[0])))
    full = F.size(steps[1]) >= WINDOW
    width, at = 1, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        df = df.withColumn(steps[at + 1], F.when(full, _pairwise_least(F.col(steps[at]), step)))
        width, at = width + step, at + 1
    fewer = F.when(F.size(steps[1]) > 0, F.array(F.array_min(steps[1]))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, F.when(full, F.array_distinct(steps[at])).otherwise(fewer)).drop(*steps)


def fingerprint_hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda p: F.shiftright(p, _POSITION_BITS).cast("int")))


def fingerprint_string(fingerprint: str) -> Column:
    """hash@position of each selected gram, in order."""
    return F.array_join(F.transform(fingerprint, lambda p: F.concat(F.lower(F.hex(F.shiftright(p, _POSITION_BITS))), F.lit("@"), (F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes; 1.0 if both are empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): the general operator, one pass, no shuffle."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return with_fingerprint(slim, "text", "packed").select("doc_id", fingerprint_string("packed").alias("fingerprint"))


def _neighbours(keyed: DataFrame) -> DataFrame:
    """For each distinct key (a, b) its predecessor in descending order (the first's is the last) and the predecessor's text length. Range-partitioned;
    only one row for each partition meets in one task."""
    slim = keyed.groupBy("a", "b").agg(F.max(F.length("text")).alias("n"))
    order = [F.col("a").desc(), F.col("b").desc()]
    ranged = materialise(slim.repartitionByRange(shuffle_partitions(keyed), *order).withColumn("part", F.spark_partition_id()), "op2-order")
    tail = F.struct("a", "b", "n")
    tails = ranged.groupBy("part").agg(F.min(tail).alias("tail"))
    last = tails.agg(F.min("tail").alias("last"))
    before = tails.withColumn("before", F.lag("tail").over(Window.orderBy("part"))).crossJoin(F.broadcast(last)).select("part", F.coalesce("before", "last").alias("before"))
    inside = F.lag(tail).over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("prior", F.coalesce("inside", "before")).select("a", "b", F.col("prior.a").alias("prior_a"), F.col("prior.b").alias("prior_b"), F.floor(F.col("prior.n") / 3).cast("int").alias("prior_need"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the start of the next document's), with their likeness."""
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long")).alias("a"), F.xxhash64("text").alias("b"), "text"
    )
    # both roles of a text (edited, and next of another) read the same columns of this join, so its exchange is made once and reused
    placed = keyed.join(_neighbours(keyed), ["a", "b"])
    heads = with_fingerprint(placed, "text", "packed").select(
        F.col("prior_a").alias("a"), F.col("prior_b").alias("b"), F.expr("substring(text, 1, prior_need)").alias("head"), fingerprint_hashes("packed").alias("next_hashes")
    )
    heads = heads.dropDuplicates(["a", "b"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    df = placed.join(heads, ["a", "b"]).withColumn("n_chars", n.cast("long"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("head", F.lit(1), third)))
    df = with_fingerprint(with_fingerprint(df, "text", "own"), "edited", "other")
    df = df.withColumn("own_hashes", fingerprint_hashes("own")).withColumn("other_hashes", fingerprint_hashes("other"))
    return df.select(
        F.nullif(F.col("a"), F.lit(_NO_ID)).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_string("own").alias("fingerprint"),
        fingerprint_string("other").alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("other_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
