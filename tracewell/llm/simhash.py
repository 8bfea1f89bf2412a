"""Operator 3. SimHash near-duplicates: fingerprints, BK-tree search by shard, connected components.

Equal fingerprints are one node. Two fingerprints at most 3 bits apart agree in one of four 16-bit blocks, so a shard holds the distinct fingerprints with one value of
one block, and a link is found in the shard of a block that both share. In its task a shard becomes a BK-tree, and its members search it. The trees are not
broadcast: all fingerprints of the corpus have no size bound; trees and searches meet by the shuffle on the shard's key instead. A shard of more than PART fingerprints (a block value of many
texts, or any shard of a corpus of billions) is cut once more, by four 12-bit blocks of its members' other 48 bits, of which two linked fingerprints agree in one again: four rows a member. What is larger still (near copies of one
text) is dealt into parts of about PART fingerprints; every part searches the tree of every part of its shard once. A task gives a forest of links
(at most one per member), never all pairs: with the forest's transitive closure no link between different fingerprints is lost.

Words: runs other than ASCII white space of the text with A-Z lower-cased. Shingles: 3 words, repeats included; fewer words make one shingle; none give
fingerprint 0, linked like any other. Null texts have no words. Rows that share a doc_id stay separate rows. A null doc_id is never the smallest unless there is no
other in the component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bktree import Forest, find, joined
from tracewell.llm.common import SPACES, map_text, materialise, shuffle_partitions, text_buffer, unpacked, word_spans
from tracewell.llm.graph import connected_components

WORDS, SEED, RADIUS, BLOCKS = 3, 42, 3, 4
#: Members of a shard, or of a shard's part.
PART = 4096
#: What makes a task's unit of search: a shard (its block, that block's value, a block of the other bits and its value; -1: not cut again) and the two of its parts that meet.
SHARD = ["block", "value", "inner", "inner_value"]
KEYS = [*SHARD, "part", "other"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit SimHash for each text."""
    data = _LOWER[data]
    starts, ends, firsts = word_spans(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    length = ends - starts
    at = np.cumsum(length + 1) - length - 1  # of each word once all are joined by one space
    joined_words = np.full(at[-1] + length[-1], 32, np.uint8)
    inside = ~SPACES[data]
    joined_words[np.arange(inside.sum()) + np.repeat(np.arange(len(starts)), length)] = data[inside]
    count = np.diff(firsts)
    shingles = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    begin = np.cumsum(shingles) - shingles
    place = np.arange(shingles.sum()) - np.repeat(begin, shingles)
    first = np.repeat(firsts[:-1], shingles) + place
    last = np.minimum(first + WORDS, np.repeat(firsts[1:], shingles)) - 1
    raw, xxh = joined_words.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((xxh(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + length[last]).tolist())), np.uint64, len(first))
    some = shingles > 0
    each = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(each, begin[some], axis=0, dtype=np.int32)
    bits = (2 * ones > shingles[some][:, None]).astype(np.uint64)
    out[some] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = shingle_fingerprints(*text_buffer(batch.column("text")))
    return pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "print"])


def _text_key() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, print): a digest of the text and the fingerprint, as signed 64-bit numbers."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_key().alias("text_key"))
    return map_text(slim, _kernel, "doc_id long, text_key long, print long")


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the shards of a partition, whose rows come sorted by shard. Shards are searched together in blocks of whole shards."""

    def links(df: pd.DataFrame) -> pd.DataFrame:
        value = df["print"].to_numpy().view(np.uint64)
        tree = df["tree"].to_numpy()
        key = df[KEYS].to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
        shard = np.cumsum(new) - 1
        members = np.flatnonzero(tree)
        forest = Forest(value[members], shard[members])
        roots = np.full(shard[-1] + 1, -1)
        roots[shard[members][forest.roots]] = forest.roots
        seek = np.flatnonzero((~tree | (df["part"] == df["other"]).to_numpy()) & (roots[shard] >= 0))
        parent = np.arange(len(value))
        for query, node in forest.within(value[seek], roots[shard[seek]], RADIUS):
            joined(parent, seek[query], members[node])
        root = find(parent, np.arange(len(value)))
        on = root != np.arange(len(value))
        return pd.DataFrame({"a": df["print"].to_numpy()[on], "b": df["print"].to_numpy()[root[on]]})

    held: list[pd.DataFrame] = []  # the rows of one shard, whose end has not come yet
    for frame in frames:
        if not len(frame):
            continue
        key = frame[KEYS].to_numpy()
        others = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(others[-1]) + 1 if len(others) else 0
        if held and not cut and (held[-1][KEYS].iloc[-1].to_numpy() != key[-1]).any():
            yield links(pd.concat(held))
            held = []
        if cut:
            yield links(pd.concat([*held, frame.iloc[:cut]]))
            held = []
        held.append(frame.iloc[cut:])
    if held:
        yield links(pd.concat(held))


def _bits(x: F.Column, at: int, width: int) -> F.Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column print) that connect all that are within RADIUS bits of each other."""
    width, inner_width = 64 // BLOCKS, (64 - 64 // BLOCKS) // BLOCKS
    own, low = F.col("print"), lambda n: F.lit((1 << n) - 1)
    # each block, and the bits beside it
    blocks = F.array(*(F.struct(_bits(own, width * i, width).alias("value"), (F.shiftleft(_bits(own, width * (i + 1), 64 - width * (i + 1)) if i + 1 < BLOCKS else F.lit(0).cast("long"), width * i)).bitwiseOR(own.bitwiseAND(low(width * i))).alias("rest")) for i in range(BLOCKS)))
    shards = prints.select("print", F.posexplode(blocks).alias("block", "b")).select("print", "block", "b.value", "b.rest")
    sized = shards.join(shards.groupBy("block", "value").agg(F.count("*").alias("n")), ["block", "value"])
    inner = F.array(*(_bits(F.col("rest"), inner_width * i, inner_width) for i in range(BLOCKS)))
    whole = F.col("n") <= PART
    cells = F.when(whole, F.array(F.struct(F.lit(-1).alias("inner"), F.lit(0).cast("long").alias("inner_value")))).otherwise(F.transform(inner, lambda v, i: F.struct(i.alias("inner"), v.alias("inner_value"))))
    rows = sized.select("print", "block", "value", F.explode(cells).alias("c")).select("print", "block", "value", "c.inner", "c.inner_value")
    hot = rows.where("inner >= 0").groupBy(*SHARD).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(hot, SHARD, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    # every unordered pair of parts once: the tree is made of the lower one's members
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(*SHARD, F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"), (F.col("own") <= F.col("with")).alias("tree"), "print")
    dealt = rows.repartition(shuffle_partitions(prints), *KEYS).sortWithinPartitions(*KEYS, "print")
    return dealt.mapInPandas(_search, "a long, b long").distinct()


def _classes(prints: DataFrame, least: F.Column) -> DataFrame:
    """(print, least, component) of every distinct fingerprint; least: an aggregate over its rows."""
    classes = prints.groupBy("print").agg(least.alias("least"))
    component = connected_components(links(classes.select("print")).select("a", "b"))
    return classes.join(component, classes["print"] == component["node"], "left").select(classes["print"].alias("print"), "least", F.coalesce("component", classes["print"]).alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    prints = materialise(simhash(docs).select("doc_id", "print"), "op3-prints")
    classes = _classes(prints, F.min("doc_id"))
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialise(classes.join(named, "component").select("print", "component_id"), "op3-classes")
    return prints.join(by_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the least (doc_id, text digest), null doc_ids last; rows equal in both are interchangeable."""
    prints = materialise(simhash(docs), "op3-prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    keep = _classes(prints, least).groupBy("component").agg(F.min("least").alias("least")).select(F.array("least.doc_id", "least.text_key").alias("key"))
    # equal rows are combined before the shuffle; the key is one array, so that the join needs no shuffle of its own (null ids are equal inside an array)
    rows = docs.select(F.array(F.col("doc_id").cast("long"), _text_key()).alias("key"), F.struct("*").alias("row"))
    return rows.dropDuplicates(["key"]).join(keep, "key", "left_semi").select(*unpacked("row", docs))
