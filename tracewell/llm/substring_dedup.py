"""Operator 1. Passages of over 50 words that documents share, found by winnowed word windows and confirmed window by window.

The text is a sequence of words (runs of bytes other than ASCII white space), over which a gear hash rolls: shifted by GEAR_SHIFT bits at each word and added a random number of that word, so that it forgets all but the last 22 words. A window is `min_words`
consecutive words (51). The least gear hash inside a window is its seed, and content-defined chunks are cut where the seed changes: a chunk is a run of neighbouring windows with one seed. All this depends on the window's words only, so equal windows have equal seeds
wherever they stand: no shared window is missed, however periodic its words or whatever is around it, and an insertion moves no chunk but those next to it. (Cuts at hashes with some zero bits, the usual rule, miss passages in which no hash has them.)

A seed in one document only settles all its windows: nobody shares them. If all chunks of a repeated seed are equal (by digests of their windows), so are their windows. Only the windows of other repeated seeds are
compared one by one, by their digests. Windows count as equal if seed and digest are, 128 bits. A window is shared if another document has it, word for word; its owner is the smallest doc_id that has it. A span is a
run of neighbouring shared windows of one owner, so it has `min_words` words at least; spans of different owners overlap where their windows do. It is kept where the owner is the document itself.

Rows of a hot seed or window (one line in a third of all documents) are pre-aggregated per task; the join back is a plain equi-join against
unique keys, which adaptive execution splits. Nothing is broadcast or collected.

Null and empty texts, and those of fewer words than a window, have no spans. Rows that share a doc_id count as one document, with spans for each text; rows without one are left out. Repeats
inside one document count if asked for (within=True, as the query does): then the owner of a window is its first place of all. doc_ids must be whole numbers: other types raise TypeError before anything runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from tracewell.llm.common import map_text, materialise, mix64, segment_hash, text_buffer, unpacked, word_hashes, word_spans

#: Most windows of a chunk; longer ones (periodic texts) are cut, and their windows compared one by one.
MAX_WINDOWS = 256
#: Least words of a shared passage.
MIN_WORDS = 51
#: Bits by which the gear hash moves at each word.
GEAR_SHIFT = 3

_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def _rolling(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every run of `length` words."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    powers, back = np.full(n, _STEP, np.uint64), np.full(n - length + 1, _BACK, np.uint64)
    powers[0] = back[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * np.cumprod(powers), out=sums[1:])
    back = np.cumprod(back)
    return mix64((sums[length:] - sums[:-length]) * back)


def _gear(words: np.ndarray, length: int) -> np.ndarray:
    """The gear hash over each run of `length` words, 22 at most: sums over 2, 4, 8 ... words, put together."""
    done, have, at = np.zeros(len(words), np.uint64), 0, words
    step = 1
    while step <= length:  # `at` covers `step` words up to each place
        if length & step:
            done[have:] += at[: len(at) - have] << np.uint64(GEAR_SHIFT * have)
            have += step
        longer = at.copy()
        longer[step:] += at[:-step] << np.uint64(min(GEAR_SHIFT * step, 63))
        at, step = longer, step * 2
    return mix64(done[length - 1 :])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _chunk_kernel(min_words: int):
    part = min((min_words + 1) // 2, -(-64 // GEAR_SHIFT))
    names = ["doc_id", "text_key", "seed", "digest", "start_word", "windows"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(batch.column("text"))
        starts, ends, firsts = word_spans(data, offsets)
        n = np.maximum(np.diff(firsts) - min_words + 1, 0)
        if not n.sum():
            return pa.record_batch([*(pa.array([], pa.int64()) for _ in names[:-1]), pa.array([], pa.list_(pa.int64()))], names)
        words = word_hashes(data, starts, ends)
        seeds, digests = _least(_gear(words, part), min_words - part + 1), _rolling(words, min_words)
        doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seeds, digests = seeds[firsts[doc] + place], digests[firsts[doc] + place]
        new = np.ones(len(doc), bool)
        new[1:] = (seeds[1:] != seeds[:-1]) | (doc[1:] != doc[:-1])
        run = np.flatnonzero(new)
        new |= (np.arange(len(doc)) - np.repeat(run, np.diff(run, append=len(doc)))) % MAX_WINDOWS == 0
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(doc))
        windows = pa.ListArray.from_arrays(pa.array(np.append(a, len(doc)), pa.int32()), pa.array(digests.view(np.int64)))
        keys = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[doc[a]]) for c in ("doc_id", "text_key")]
        return pa.record_batch([*keys, pa.array(seeds[a].view(np.int64)), pa.array(segment_hash(digests, a, b).view(np.int64)), pa.array(place[a]), windows], names)

    return kernel


def chunks(docs: DataFrame, min_words: int = MIN_WORDS, repeated_ids: bool = True) -> DataFrame:
    """(doc_id, text_key, seed, digest, start_word, windows): every chunk of every text, with the digests of its windows; text_key tells texts of one doc_id apart (0, if no doc_id is said to repeat)."""
    _check_ids(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("text_key", _text_key() if repeated_ids else F.lit(0).cast("long"))
    return map_text(slim, _chunk_kernel(min_words), "doc_id long, text_key long, seed long, digest long, start_word long, windows array<long>")


def _text_key() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def _check_ids(docs: DataFrame) -> None:
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")


def _has_repeated_ids(docs: DataFrame) -> bool:
    """Some doc_id stands in several rows. Texts need keys of their own only then; without them the shuffles take 2.8 instead of 3.9 times the input in the check's tables. Results are the same."""
    _check_ids(docs)
    return docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def _places(every: DataFrame, within: bool) -> DataFrame:
    """Runs of windows that other documents have (within: that stand anywhere else): (doc_id, text_key, start_word, n, first_doc_id, kept); kept: the owner is the document itself (within: this is the first place of all)."""
    here = F.struct("doc_id", "text_key", "start_word")
    counts = [F.min(here).alias("first"), F.max(here).alias("last")]
    again = F.col("first") < F.col("last") if within else F.col("first.doc_id") < F.col("last.doc_id")
    # a window twice in one chunk: its chunk's digest does not settle it
    loops = F.size(F.array_distinct("windows")) < F.size("windows") if within else F.lit(False)
    seeds = every.groupBy("seed").agg(*counts, F.min("digest").alias("low"), F.max("digest").alias("high"), F.max(loops).alias("loops"))
    seeds = seeds.where(again | F.col("loops")).select("seed", "first", ((F.col("low") < F.col("high")) | F.col("loops")).alias("mixed"))
    kept = F.col("first") == here if within else F.col("first.doc_id") == F.col("doc_id")
    out = ["doc_id", "text_key", "start_word", "n", F.col("first.doc_id").alias("first_doc_id"), kept.alias("kept")]
    found = every.drop("digest").join(seeds, "seed").withColumn("n", F.size("windows"))
    found = materialise(found.select("doc_id", "text_key", "start_word", "n", "first", F.when(F.col("mixed"), F.col("seed")).alias("seed"), F.when(F.col("mixed"), F.col("windows")).alias("windows")), "op1-found")
    each = _each(found.where("windows is not null"))
    shared = each.groupBy("seed", "digest").agg(*counts).where(again).select("seed", "digest", "first")
    return found.where("windows is null").select(*out).union(each.join(shared, ["seed", "digest"]).withColumn("n", F.lit(1)).select(*out))


def _each(found: DataFrame) -> DataFrame:
    """A row for each window of chunks."""
    each = found.select("doc_id", "text_key", "start_word", "seed", F.posexplode("windows").alias("i", "digest"))
    return each.select("doc_id", "text_key", "seed", "digest", (F.col("start_word") + F.col("i")).alias("start_word"))


def _spans(docs: DataFrame, min_words: int, within: bool, repeated_ids: bool) -> DataFrame:
    every = chunks(docs, min_words, repeated_ids)
    places = _places(every, within)
    in_text = Window.partitionBy("doc_id", "text_key").orderBy("start_word")
    end = F.col("start_word") + F.col("n")
    before = lambda c: F.lag(c).over(in_text)
    opens = (before(end) < F.col("start_word")) | (before("first_doc_id") != F.col("first_doc_id")) | (before("kept") != F.col("kept"))
    spans = places.withColumn("opens", F.coalesce(opens.cast("int"), F.lit(1))).withColumn("span", F.sum("opens").over(in_text)).groupBy("doc_id", "text_key", "span").agg(
        F.min("start_word").alias("start_word"),
        (F.max(end) - F.min("start_word") + F.lit(min_words - 1)).alias("n_words"),
        F.min("first_doc_id").alias("first_doc_id"),
        F.min("kept").alias("kept"),
    )
    return spans.drop("span")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, kept): spans that other documents have too (within: or that stand in the same one again); kept: no earlier document (within: no earlier place) has any window of it."""
    return _spans(docs, min_words, within, _has_repeated_ids(docs)).drop("text_key")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, starts: pd.Series, lengths: pd.Series, kept: pd.Series) -> pd.Series:
    """Each text without the words that lie in spans that are not kept and in none that is, each with the white space after it (the last words of a text: without)."""
    out = []
    for text, at, n, keep in zip(texts, starts, lengths, kept):
        raw = text.encode()
        begins, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        cover = np.zeros((2, len(begins) + 1), np.int64)
        for side in (0, 1):
            of = np.asarray(keep, bool) == bool(side)
            np.add.at(cover[side], np.asarray(at)[of], 1)
            np.add.at(cover[side], (np.asarray(at) + np.asarray(n))[of], -1)
        inside = np.cumsum(cover, axis=1) > 0
        cut = np.flatnonzero(np.diff((inside[0] & ~inside[1]).astype(np.int8), prepend=0))  # starts and stops of cut runs of words, in turn
        stops = np.where(cut[1::2] < len(begins), np.append(begins, len(raw))[cut[1::2]], ends[-1] if len(ends) else 0)
        pieces, done = [], 0
        for start, stop in zip(begins[cut[::2]].tolist(), stops.tolist()):
            pieces.append(raw[done:start])
            done = stop
        out.append(b"".join([*pieces, raw[done:]]).decode())
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """docs with the words cut out that lie in spans of earlier documents (within: of earlier places) and in none that is kept, so that every shared window stays whole in its owner. A word goes with the white space after it; all else of each text stays as it is, byte for byte: lines, lists, tabs."""
    repeated_ids = _has_repeated_ids(docs)
    spans = _spans(docs, min_words, within, repeated_ids).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start_word", "n_words", "kept")).alias("spans")).where(F.exists("spans", lambda s: ~s.kept))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), (_text_key() if repeated_ids else F.lit(0).cast("long")).alias("key"))
    joined = rows.join(spans, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    # texts without spans go through the function too (as empty ones), since Spark evaluates it for all rows of a batch
    none = F.array().cast("array<long>")
    some = F.col("spans").isNotNull()
    part = lambda name, kind: F.when(some, F.col(f"spans.{name}")).otherwise(none.cast(f"array<{kind}>"))
    left = _without(F.when(some, F.col("text")).otherwise(F.lit("")), part("start_word", "long"), part("n_words", "long"), part("kept", "boolean"))
    cut = F.when(some, left).otherwise(F.col("text"))
    return joined.select(*(cut.alias(c) if c == "text" else x for c, x in zip(docs.columns, unpacked("row", docs))))
