"""Operator 4. Quality classifier: a generalised additive model with pairwise interactions.

Features are statistics of the whole text. Each is cut into bins; cyclic boosting visits the features in turn and fits a shallow tree (up to four leaves over the bins) to the residuals
of the log loss, adding it, shrunk, to the feature's lookup table; then the pairs whose grids explain most of what is left get tables of their own in the same way. A score is the logistic of the sum of
looked-up bin values, vectorised over a block of documents.

The model is fitted on a bounded sample of labelled documents: the SAMPLE labels whose doc_ids hash lowest, at every size of corpus; where rows repeat a doc_id, at most SAMPLE of its labels' rows, chosen by hash. Their features are computed on Spark; only
numbers come to the driver. Scoring is one pass without a shuffle.

Null and empty texts have all features zero and are scored like any other. A doc_id labelled more than once counts with each label; null labels are not used. Repeated rows get equal scores. Without labels of both
classes every score is the share of good labels (0.5 if there are none). Other columns are ignored, or kept by `kept_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import blocks, crc32_of, fields, map_text, numbered, segment_hash, text_buffer, word_hashes, word_spans

#: Labelled documents that the model is fitted on at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.15, 2.0
#: Scores from here on count as good.
THRESHOLD = 0.3

FEATURES = ["words", "word_length", "longest_word", "upper", "digits", "stops", "exclaims", "symbols", "marks", "non_ascii", "distinct", "top_word", "lines", "line_words", "repeated_lines", "odd_ends", "shouted", "repeated_triples", "spaces"]


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_LOWER = _class(bytes(range(97, 123)))
_STOP, _EXCLAIM, _SYMBOL, _MARK = _class(b".,;:"), _class(b"!?"), _class(b"#$%&*@^~|<>{}[]\\/_=+"), _class(b"'\"()-`")
_HIGH, _SPACE, _NEWLINE = np.arange(256) >= 128, _class(b" \t\n\r\v\f"), _class(b"\n")


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of distinct values, and the count of the most frequent."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(value):
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))
        count = np.diff(np.append(new, len(doc)))
        np.add.at(distinct, doc[new], 1)
        np.maximum.at(top, doc[new], count)
    return distinct, top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)

    def share(members: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(members[data], dtype=np.int64)])[offsets]) / size

    starts, ends, firsts = word_spans(data, offsets)
    words = np.diff(firsts)
    some, per = np.maximum(words, 1), np.repeat(np.arange(n), words)
    length = ends - starts
    hashes = word_hashes(data, starts, ends)
    distinct, top = _distinct(per, hashes, n)
    longest = np.zeros(n)
    np.maximum.at(longest, per, length)
    by_word = lambda flag: np.bincount(per, weights=flag, minlength=n) / some
    last = data[ends - 1] if len(ends) else data[:0]
    odd = _SYMBOL[last] | _EXCLAIM[last]
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    lowers = np.concatenate([[0], np.cumsum(_LOWER[data], dtype=np.int64)])
    shouted = (uppers[ends] - uppers[starts] > 0) & (lowers[ends] == lowers[starts])
    line_starts, line_ends, line_firsts = word_spans(data, offsets, _NEWLINE)
    lines = np.diff(line_firsts)
    line_of = np.repeat(np.arange(n), lines)
    line_kinds, _ = _distinct(line_of, segment_hash(data.astype(np.uint64) + np.uint64(1), line_starts, line_ends), n)
    triple = hashes.copy()
    for j in (1, 2):
        triple[:-j] += hashes[j:] * np.uint64(2 * j + 1) if len(hashes) > j else np.uint64(0)
    inside = np.arange(len(hashes)) + 3 <= np.repeat(firsts[1:], words)
    kinds, _ = _distinct(per[inside], triple[inside], n)
    triples = np.bincount(per[inside], minlength=n)
    columns = [
        np.log1p(words), np.bincount(per, weights=length, minlength=n) / some, np.log1p(longest), share(_UPPER), share(_DIGIT), share(_STOP), share(_EXCLAIM), share(_SYMBOL), share(_MARK), share(_HIGH),
        distinct / some, top / some, np.log1p(lines), words / np.maximum(lines, 1), 1 - line_kinds / np.maximum(lines, 1), by_word(odd), by_word(shouted), 1 - kinds / np.maximum(triples, 1), share(_SPACE),
    ]
    out = np.stack(columns, axis=1).astype(np.float64)
    out[words == 0] = 0
    return out


def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, by bin, of the shallow tree that fits gradient sums g and Hessian sums h best: a split, and one more on either side."""

    def split(a: int, b: int) -> int:
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(left_g):
            return a
        right_g, right_h = g[a:b].sum() - left_g, h[a:b].sum() - left_h
        gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE)
        return a + 1 + int(gain.argmax())

    n = len(g)
    middle = split(0, n)
    cuts = sorted({0, n, middle, split(0, middle) if middle else 0, split(middle, n)})
    out = np.empty(n)
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut of a grid into four quadrants."""
    n = len(g)
    sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h)]
    cut = np.arange(1, n)
    gain, parts = 0, []
    for rows in ((0, cut), (cut, n)):
        for cols in ((0, cut), (cut, n)):
            r, c = np.meshgrid(cut, cut, indexing="ij")
            lo_r, hi_r = (0, r) if isinstance(rows[0], int) else (r, n)
            lo_c, hi_c = (0, c) if isinstance(cols[0], int) else (c, n)
            total_g, total_h = (s[hi_r, hi_c] - s[lo_r, hi_c] - s[hi_r, lo_c] + s[lo_r, lo_c] for s in sums)
            gain = gain + total_g**2 / (total_h + RIDGE)
            parts.append(total_g / (total_h + RIDGE))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty((n, n))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = (p[i, j] for p in parts)
    return float(gain.max()), out


@dataclass
class Additive:
    """Base log-odds, cut points and a lookup table for each feature, and grids for pairs of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    good = float(y.mean()) if len(y) else 0.5
    if not len(y) or good in (0.0, 1.0):
        return Additive(float(np.log(max(good, 1e-3) / max(1 - good, 1e-3))), [], [], [], [], [])
    cuts = lambda column, n: np.unique(np.quantile(column, np.arange(1, n) / n))
    edges, pair_edges = [cuts(c, BINS) for c in x.T], [cuts(c, PAIR_BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(pair_edges, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    base = float(np.log(good / (1 - good)))
    total = np.full(len(y), base)

    def sums(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)

    for _ in range(ROUNDS):
        for j, at in enumerate(bins):
            step = RATE * _leaves(*sums(at, len(tables[j])))
            tables[j] += step
            total += step[at]
    flat = lambda a, b: coarse[a] * PAIR_BINS + coarse[b]
    grid = lambda at: (s.reshape(PAIR_BINS, PAIR_BINS) for s in sums(at, PAIR_BINS**2))
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quadrants(*grid(flat(*p)))[0])
    pairs = ranked[:PAIRS]
    grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(pairs):
            at = flat(*pair)
            step = RATE * _quadrants(*grid(at))[1]
            grids[k] += step
            total += step.ravel()[at]
    return Additive(base, edges, tables, pair_edges, pairs, grids)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Fit on at most `sample` labels whose doc_id's CRC-32 is not 0 modulo 5, and on at most `sample` of the rows that have them (more only where doc_ids repeat), those whose features hash lowest."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(crc32_of("doc_id") % 5 != 0)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(*text_buffer(batch.column("text")))
        return pa.record_batch([batch.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["quality", "x"])

    found = map_text(rows, kernel, "quality int, x array<double>").orderBy(F.xxhash64("x", "quality"), "x", "quality").limit(sample).toPandas()
    return fit(np.array(found["x"].tolist()).reshape(-1, len(FEATURES)), found["quality"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Additive, keep: list[str]) -> tuple[DataFrame, list[F.Column]]:
    """The score of every document beside its columns in `keep`, which the columns returned bring back under their names."""
    slim, carried, back = numbered(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                score = model.score(features(*text_buffer(block.column("text"))))
                yield pa.record_batch([*(block.column(c) for c in carried), pa.array(score)], [*carried, "score"])

    return slim.mapInArrow(run, fields(slim, carried, "score double")), back


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out, back = scored(docs, train(docs, labels, sample), ["doc_id"])
    out = out.select(*back, "score")
    return out.select("doc_id", (crc32_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those that are predicted bad. No column of docs is read but doc_id and text, and none is changed, whatever their names."""
    out, back = scored(docs, train(docs, labels, sample), docs.columns)
    return out.where(F.col("score") >= THRESHOLD).select(*back)
