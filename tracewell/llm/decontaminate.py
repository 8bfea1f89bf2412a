"""Operator 10. Benchmark decontamination with suffix arrays over the training text.

Each task makes a suffix array of the words of a block of documents (a shard) and binary-searches every distinct test suffix in it, all suffixes of the benchmark at
once; matches are extended to the longest verbatim match. A suffix that breaks off, by a word or a pair of neighbouring words that no test item has, before the shortest
window can match nothing, so it is left out of the array; a test suffix whose first two words stand nowhere in the shard is not searched there. A benchmark of one block needs no shuffle: documents stay where they are read.

The test side is sent to the tasks in blocks of items of about BENCH_WORDS words (some 20 bytes a word). A benchmark of more is searched block by block: the driver makes a block, the rows that it hits are written
to the shared folder under their text's MD5, and only then is the next one made. The hits of all blocks are joined to the documents by that digest, so that no row needs a number that a retried task might change.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is 13 consecutive words of an item; an item of fewer, but not none, is one window. A
document is contaminated if it has a hit word and hits make up 5 % of its words or more. Null texts have no words; items without words match nothing; items with equal
words are searched once and all counted. A null item_id counts as the empty string. Of equally long longest matches the first in the document counts, then the least item_id. Repeated rows get equal results; other columns are
ignored by the query and kept by `remove_contaminated`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import blocks, fields, materialise, numbered, text_buffer, word_array, word_spans

WINDOW = 13
#: Words of test items that are sent to the tasks at once.
BENCH_WORDS = 500_000

_SPLIT = np.zeros(256, bool)
_SPLIT[:0x30] = _SPLIT[0x3A:0x61] = _SPLIT[0x7B:0x80] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def item_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    data = _LOWER[data]
    starts, ends, firsts = word_spans(data, offsets, _SPLIT)
    return word_array(data, starts, ends, _SPLIT), firsts


@dataclass
class TestSuffixes:
    """The searched side: a vocabulary, the pairs of neighbouring words, the items' words one after the other (-2 between), and the distinct windows with all the places where they begin."""

    vocabulary: pa.Array
    pairs: np.ndarray
    stream: np.ndarray
    #: of each distinct window: a place, its number of words, and its first two words as a pair (-1: it has one)
    sample: np.ndarray
    length: np.ndarray
    first_pair: np.ndarray
    #: places of window w: places[at[w] : at[w + 1]]
    at: np.ndarray
    places: np.ndarray
    #: where each class of equal items begins, and their ids
    begin: np.ndarray
    ids: list[list[str]]

    @staticmethod
    def of(ids: list[str], texts: list[str | None]) -> TestSuffixes:
        words, firsts = item_words(*text_buffer(pa.array(texts, pa.string())))
        coded = words.dictionary_encode()
        code, size = coded.indices.to_numpy().astype(np.int32), len(coded.dictionary)
        classes: dict[bytes, list[str]] = {}
        for i, name in enumerate(ids):
            if firsts[i] < firsts[i + 1]:
                classes.setdefault(code[firsts[i] : firsts[i + 1]].tobytes(), []).append(name)
        items = [np.frombuffer(key, np.int32) for key in classes]
        begin = np.cumsum([0, *(len(x) + 1 for x in items)])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        stream = join([y for x in items for y in (x, [-2])] + [np.full(WINDOW, -2)], np.int32)
        place = join([b + np.arange(max(len(x) - WINDOW + 1, 1)) for b, x in zip(begin, items)], np.int64)
        length = join([np.full(max(len(x) - WINDOW + 1, 1), min(len(x), WINDOW)) for x in items], np.int64)
        rows = _rows(stream, place, length)
        _, sample, of = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(rows) else (None, place, place)
        order = np.argsort(of.ravel(), kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(of.ravel(), minlength=len(sample)))])
        first, second = stream[place[sample]].astype(np.int64), stream[np.minimum(place[sample] + 1, len(stream) - 1)]
        pairs = np.unique(join([x[:-1].astype(np.int64) * size + x[1:] for x in items], np.int64))
        return TestSuffixes(coded.dictionary, pairs, stream, place[sample], length[sample], np.where(length[sample] > 1, first * size + second, -1), at, place[order], begin[:-1], list(classes.values()))


def _rows(stream: np.ndarray, place: np.ndarray, length: np.ndarray, end: int = -2) -> np.ndarray:
    """The words of each window, filled up with `end`."""
    step = np.arange(WINDOW)
    return np.where(step < length[:, None], stream[np.minimum(place[:, None] + step, max(len(stream) - 1, 0))], np.int32(end))


def _bound(array: np.ndarray, windows: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For each test suffix the first row of the sorted array not below it (upper: above it), by binary search of all at once."""
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(array))
    counted = np.arange(WINDOW) < length[:, None]
    while (open_ := low < high).any():
        at = np.flatnonzero(open_)
        middle = (low[at] + high[at]) // 2
        rows, wanted = array[middle], windows[at]
        differs = (rows != wanted) & counted[at]
        first = differs.argmax(axis=1)
        each = np.arange(len(at))
        right = np.where(differs[each, first], rows[each, first] < wanted[each, first], upper)
        low[at[right]] = middle[right] + 1
        high[at[~right]] = middle[~right]
    return low


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them), for all i."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def search(words: pa.Array, firsts: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of test suffixes: word position in the shard, place in the test stream, length of the longest verbatim match from there."""
    n, none = len(words), np.zeros(0, np.int64)
    if not n or not len(test.sample):
        return none, none, none
    size = len(test.vocabulary)
    code = pc.index_in(words, value_set=test.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    follows = np.zeros(n, bool)
    known = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
    pair = code[known].astype(np.int64) * size + code[known + 1]
    at = np.searchsorted(test.pairs, pair)
    follows[known] = (at < len(test.pairs)) & (test.pairs[np.minimum(at, len(test.pairs) - 1)] == pair) if len(test.pairs) else False
    follows[firsts[1:][firsts[1:] > 0] - 1] = False
    breaks = np.flatnonzero(~follows)
    run = np.repeat(breaks, np.diff(breaks, prepend=-1)) - np.arange(n) + 1
    starts = np.flatnonzero((run >= test.length.min()) & (code >= 0))
    if not len(starts):
        return none, none, none
    rows = _rows(code, starts, run[starts], -1)
    order = np.lexsort(rows.T[::-1])
    suffixes, rows = starts[order], rows[order]
    have = np.unique(rows[:, 0].astype(np.int64) * size + rows[:, 1])
    live = np.flatnonzero((test.first_pair < 0) | (have[np.minimum(np.searchsorted(have, test.first_pair), len(have) - 1)] == test.first_pair))
    windows = _rows(test.stream, test.sample[live], test.length[live])
    low, high = _bound(rows, windows, test.length[live], False), _bound(rows, windows, test.length[live], True)
    count = high - low
    found, suffix = suffixes[_spread(low, count)], np.repeat(live, count)
    many = np.diff(test.at)[suffix]
    found, place, longest = np.repeat(found, many), test.places[_spread(test.at[suffix], many)], np.repeat(test.length[suffix], many)
    growing = np.arange(len(found))
    while len(growing):
        here, there = found[growing] + longest[growing], place[growing] + longest[growing]
        inside = (longest[growing] < run[found[growing]]) & (there < len(test.stream))
        growing = growing[inside]
        growing = growing[code[here[inside]] == test.stream[there[inside]]]
        longest[growing] += 1
    return found, place, longest


#: A longest match: number of words (negative, so that the longest is the least), its start in the document, the item.
_BEST = pa.struct([("n", pa.int64()), ("start", pa.int64()), ("item", pa.string())])
_FOUND = "n_words long, spans array<long>, items array<string>, best struct<n:long,start:long,item:string>"
_VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_start long, longest_item string"


def _hits(batch: pa.RecordBatch, test: TestSuffixes, columns: list[str]) -> pa.RecordBatch:
    """For each row its number of words, the hit words as start, end, start, end ... in order, the items with windows in it, and its longest match."""
    words, firsts = item_words(*text_buffer(batch.column("text")))
    found, place, longest = search(words, firsts, test)
    item = np.searchsorted(test.begin, place, "right") - 1
    size = np.diff(np.append(test.begin, max(len(test.stream) - WINDOW, 0)))[item] - 1 if len(found) else found
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + np.minimum(size, WINDOW), -1)
    hit = np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8)])
    edge = np.diff(np.concatenate([hit, [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = firsts[1:-1]  # a run of hits may go on into the next document
    inner = cut[(hit[cut] == 1) & (hit[np.minimum(cut + 1, len(hit) - 1)] == 1) & (cut > 0) & (cut < len(words))] if len(words) else cut[:0]
    starts, ends = np.union1d(starts, inner), np.union1d(ends, inner)
    doc = np.searchsorted(firsts, starts, "right") - 1
    flat = np.stack([starts - firsts[doc], ends - firsts[doc]], axis=1).ravel() if len(starts) else np.zeros(0, np.int64)
    span_at = 2 * np.searchsorted(doc, np.arange(batch.num_rows + 1))
    names: list[list[str]] = [[] for _ in range(batch.num_rows)]
    best: list[dict | None] = [None] * batch.num_rows
    if len(found):
        owner = np.searchsorted(firsts, found, "right") - 1
        for p in np.unique(owner * len(test.ids) + item).tolist():
            names[p // len(test.ids)] += test.ids[p % len(test.ids)]
        start = found - firsts[owner]
        order = np.lexsort((start, -longest, owner))
        lead = order[np.concatenate([[True], np.diff(owner[order]) > 0])]
        tied = np.flatnonzero((longest == longest[lead][np.searchsorted(owner[lead], owner)]) & (start == start[lead][np.searchsorted(owner[lead], owner)]))
        for d, n, s, k in zip(owner[tied].tolist(), longest[tied].tolist(), start[tied].tolist(), item[tied].tolist()):
            name = min(test.ids[k])
            if best[d] is None or name < best[d]["item"]:
                best[d] = {"n": -n, "start": s, "item": name}
    spans = pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.array(flat, pa.int64()))
    return pa.record_batch([*(batch.column(c) for c in columns), pa.array(np.diff(firsts)), spans, pa.array(names, pa.list_(pa.string())), pa.array(best, _BEST)], [*columns, "n_words", "spans", "items", "best"])


def _verdict(kept: list[pa.Array], columns: list[str], n_words: np.ndarray, spans: list[list[int] | None], items: list[list[str] | None], best: list[dict | None]) -> pa.RecordBatch:
    n_hit = np.zeros(len(n_words), np.int64)
    for i, flat in enumerate(spans):
        reach = -1
        for a, b in sorted(zip(flat[::2], flat[1::2])) if flat else ():
            n_hit[i] += max(0, b - max(a, reach))
            reach = max(reach, b)
    shas = [hashlib.sha256(",".join(sorted(x or ())).encode()).hexdigest() for x in items]
    part = lambda f, kind: pa.array([None if x is None else f(x) for x in best], kind)
    longest = part(lambda x: -x["n"], pa.int64()).fill_null(0)
    out = [pa.array(n_words), pa.array(n_hit), pa.array([len(x or ()) for x in items], pa.int64()), pa.array(shas), pa.array((n_hit > 0) & (20 * n_hit >= n_words)), longest, part(lambda x: x["start"], pa.int64()), part(lambda x: x["item"], pa.string())]
    return pa.RecordBatch.from_arrays([*kept, *out], [*columns, *(x.split()[0] for x in _VERDICT.split(", "))])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))


def _test_blocks(benchmark: DataFrame, most_words: int) -> tuple[int, Iterator[TestSuffixes]]:
    """The number of blocks, and the blocks, each made when it is asked for."""
    slim = _items(benchmark)
    size = slim.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = 1 + int(size) // (2 * most_words)  # a word takes two characters at least, with its separator

    def made() -> Iterator[TestSuffixes]:
        for i in range(n):
            rows = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
            yield TestSuffixes.of([r.item_id for r in rows], [r.text for r in rows])

    return n, made()


def _mapped(test: TestSuffixes, columns: list[str], out):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                yield out(_hits(block, test, columns), block)

    return run


def _judged(docs: DataFrame, benchmark: DataFrame, most_words: int, keep: list[str]) -> tuple[DataFrame, list[F.Column]]:
    """The columns of _VERDICT for each of docs, beside its columns in `keep`, which the columns returned bring back under their names."""
    n, tests = _test_blocks(benchmark, most_words)
    slim, carried, back = numbered(docs, keep)
    types = fields(slim, carried, _VERDICT)

    def verdict(found: pa.RecordBatch, block: pa.RecordBatch) -> pa.RecordBatch:
        lists = (found.column(c).to_pylist() for c in ("spans", "items", "best"))
        return _verdict([block.column(c) for c in carried], carried, found.column("n_words").to_numpy(), *lists)

    if n == 1:
        return slim.mapInArrow(_mapped(next(tests), [], verdict), types), back
    return _in_blocks(slim, tests, carried).mapInArrow(_merged(carried), types), back


def _in_blocks(slim: DataFrame, tests: Iterator[TestSuffixes], carried: list[str]) -> DataFrame:
    """Documents with their hits from all blocks of test items: each block's hits are written, by the text's digest, before the next block is made."""
    keyed = slim.withColumn("md5", F.md5(F.col("text").cast("binary")))

    def hit_rows(found: pa.RecordBatch, block: pa.RecordBatch) -> pa.RecordBatch:
        return found.filter(pc.greater(pc.list_value_length(found.column("spans")), 0))

    every = None
    for test in tests:
        hits = keyed.select("md5", "text").where("md5 is not null").mapInArrow(_mapped(test, ["md5"], hit_rows), f"md5 string, {_FOUND}").dropDuplicates(["md5"])
        hits = materialise(hits, "op10-hits")
        every = hits if every is None else every.union(hits)
    merged = every.groupBy("md5").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.min("best").alias("best"))
    return keyed.join(merged, "md5", "left").drop("md5")


def _merged(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words = np.diff(item_words(*text_buffer(block.column("text")))[1])
                yield _verdict([block.column(c) for c in carried], carried, words, *(block.column(c).to_pylist() for c in ("spans", "items", "best")))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, most_words: int = BENCH_WORDS) -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest verbatim match: longest_words, longest_start, longest_item."""
    out, back = _judged(docs, benchmark, most_words, ["doc_id"])
    return out.select(*back, *(x.split()[0] for x in _VERDICT.split(", ")))


def longest_matches(docs: DataFrame, benchmark: DataFrame, most_words: int = BENCH_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, item_word, n_words): for each document and item the longest verbatim match, and where it lies."""
    n, tests = _test_blocks(benchmark, most_words)
    out = None
    for test in tests:

        def run(batches: Iterator[pa.RecordBatch], test: TestSuffixes = test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch, "text"):
                    words, firsts = item_words(*text_buffer(block.column("text")))
                    found, place, longest = search(words, firsts, test)
                    doc, item = np.searchsorted(firsts, found, "right") - 1, np.searchsorted(test.begin, place, "right") - 1
                    best: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for d, k, p, q, m in zip(doc.tolist(), item.tolist(), found.tolist(), place.tolist(), longest.tolist()):
                        best[d, k] = max(best.get((d, k), (0, 0, 0)), (m, int(firsts[d]) - p, int(test.begin[k]) - q))
                    rows = [(block.column("doc_id")[d].as_py(), i, -p, -q, m) for (d, k), (m, p, q) in best.items() for i in test.ids[k]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "start_word", "item_word", "n_words"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, item_id string, start_word long, item_word long, n_words long")
        part = part if n == 1 else materialise(part, "op10-longest")
        out = part if out is None else out.union(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, most_words: int = BENCH_WORDS) -> DataFrame:
    """docs without the contaminated ones. No column of docs is read but text, and none is changed, whatever their names."""
    out, back = _judged(docs, benchmark, most_words, docs.columns)
    return out.where("not contaminated").select(*back)
