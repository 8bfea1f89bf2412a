"""Operator 5 (native). Mixes sources to target weights by distributed prefix sums over hash-random keys.

Sizes are numbers of words. Sources in code-point order (null last) weigh 5, 2, 1, repeating; together they share all words, and no target exceeds
CAP times its source's size (what is left over goes to the others by weight). Each document has a hash-random key; keys are uniform, so their top
bits split every source into ranges of like size without sampling, and a hot source is spread over as many ranges as any other is. Running
sums inside a range plus the sums of the ranges before it give each document's place, and each source is cut at its exact budget: whole epochs first,
then the documents up to the budget; the one on the cut gives a part of its words.

Null texts have size 0, as have sources with none but such texts; a source of size 0 has target 0. Ties of keys go by doc_id, then size, and rows that are
equal in all three are interchangeable. Other columns pass through `mixed_documents` and are ignored elsewhere. Only the table of sources (and
its ranges' sums) is ordered in one task, never documents. The corpus's size is one number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialise

#: Fixed values of the mix: weights in turn, and the largest multiple of a source's size.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows aimed at in a range of keys over all sources, and the most ranges.
RANGE_ROWS, MAX_RANGE_BITS = 512, 16


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    """A document's place in its source's random order."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling in closed form. With sources by cap over weight, the
    level is that of the first prefix of capped sources that leaves the rest below their caps."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    df = df.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    df = df.withColumn("at", F.row_number().over(by_ratio))
    df = df.withColumn("first_fit", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("at", "level"))).over(everything))
    target = F.when(F.col("at") < F.coalesce(F.col("first_fit.at"), F.lit(1 << 30)), F.col("most")).otherwise(F.least(F.col("most"), F.col("first_fit.level") * F.col("weight")))
    return df.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of docs."""
    slim = materialise(docs.select("doc_id", "source", n_words("text").alias("size"), _key(seed).alias("key")), "op5-sizes")
    return _taken(slim, ["doc_id"], weights, cap)


def _taken(slim: DataFrame, keep: list[str], weights: tuple[float, ...], cap: int) -> DataFrame:
    rows = slim.count()
    bits = min(MAX_RANGE_BITS, max(4, (rows // RANGE_ROWS).bit_length()))
    ranged = slim.withColumn("range", F.shiftrightunsigned("key", 64 - bits))
    parts = materialise(ranged.groupBy("source", "range").agg(F.sum("size").alias("part")), "op5-ranges")
    sources = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part").over(earlier), F.lit(0)))
    offsets = offsets.join(sources, offsets["source"].eqNullSafe(sources["source"])).select(offsets["source"].alias("s"), F.col("range").alias("r"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy(*(F.shiftleft("key", bits).bitwiseXOR(F.lit(-(1 << 63))), *keep, "size")).rowsBetween(Window.unboundedPreceding, -1)
    df = ranged.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(offsets, df["source"].eqNullSafe(F.col("s")) & (df["range"] == F.col("r")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("start")))
    return df.select(*keep, "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """The mix as documents, in docs' columns: each repeated once for every epoch, the one on a source's cut with its first words only. A document of which
    nothing is taken goes. Rows are told apart by doc_id, source and text."""
    grouped = docs.select("doc_id", "source", n_words("text").alias("size"), _key(seed).alias("key"), F.xxhash64("text").alias("text_hash"))
    taken = _taken(materialise(grouped, "op5-sizes"), ["doc_id", "text_hash"], weights, cap)
    copies = taken.groupBy("doc_id", "source", "text_hash").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    a = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("\x00"))).alias("j"), F.xxhash64("text").alias("t")).dropDuplicates(["j", "t"])
    b = copies.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("\x00"))).alias("j"), F.col("text_hash").alias("t"), "size", "taken").where("taken > 0")
    both = a.join(b, ["j", "t"])
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    cut = (F.col("taken") % F.col("size")).cast("int")
    both = both.withColumn("words", F.explode(F.concat(F.array_repeat(F.lit(-1), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")))))
    fields = {c: F.col("row")[c] for c in docs.columns}
    fields["text"] = F.when(F.col("words") < 0, F.col("row.text")).otherwise(F.rtrim(F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0)), F.lit(1), F.greatest("words", F.lit(1))), "")))
    if "n_chars" in fields:
        fields["n_chars"] = F.length(fields["text"]).cast(docs.schema["n_chars"].dataType)
    return both.select(*(v.alias(k) for k, v in fields.items()))
