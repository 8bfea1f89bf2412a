"""Operator 8. Language identification with string kernels.

The kernel of two texts counts the character n-grams (lengths 1 to 4, letters lower-cased, everything else one space) that both have, divided by the root of the product of their numbers: a blended-spectrum
presence kernel. n-grams are told apart by a hash into SPACE places, of which a text fills as many as it has different n-grams, so that long texts stay apart as well. Landmarks (Nyström) map a text to its kernel values with them;
one-versus-rest kernel ridge regression in that space gives a value for each language. The landmarks' places times their weights are one matrix, places by languages; a block of texts is scored by the product of its sparse presence rows with it.

The model is fitted on a bounded sample, the SAMPLE documents with a language whose texts hash lowest; the first of each language in turn are the landmarks, each of MARK_GRAMS n-grams at most (those of lowest place, a fixed thinning of very long texts). Kernel values of the
sample with them are computed on Spark; only the landmarks' places and these values come to the driver. Scoring is one pass without a shuffle and reads whole texts.

Null texts and texts without letters are `und` with score 0. Without any labelled text all are `und`. Texts of any length are scored in one piece, n-gram by n-gram; ties go to the first language by name; repeated rows get equal results; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import blocks, crc32_of, fields, map_text, materialise, numbered

#: Training documents and landmarks, and a landmark's n-grams at most.
SAMPLE, LANDMARKS, MARK_GRAMS = 3_000, 160, 20_000
NGRAMS, SPACE_BITS, RIDGE = 4, 22, 1.0
SPACE = 1 << SPACE_BITS
#: Texts whose n-grams are told apart at once, and their bytes; a longer text is taken alone, in pieces of PIECE characters.
ROWS, ROW_BYTES, PIECE = 1 << (32 - SPACE_BITS), 1 << 19, 1 << 20

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def _places(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sorted distinct keys (text, then place) of the n-grams of texts as characters, of which doc says the text."""
    base, gram, keys = doc.astype(np.uint32) << np.uint32(SPACE_BITS), np.zeros(len(codes), np.uint32), []
    for n in range(1, NGRAMS + 1):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        same = doc[: len(gram)] == doc[n - 1 :]
        keys.append((base[: len(gram)] | (mixed >> np.uint32(32 - SPACE_BITS)))[same])
    return _distinct(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse presence rows: the places of the n-grams of all texts, len(texts) + 1 offsets into them, and whether a text has a letter. Takes at most ROWS texts."""
    lowered = [(t or "").lower() for t in texts]
    has = np.zeros(len(texts), bool)
    if not texts:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), has
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) + 2 for t in lowered])
    doc = np.repeat(np.arange(len(texts)), size)
    letter = _is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space before the text and after each word
    keep[np.cumsum(size) - size] = True
    codes, doc = np.where(letter, codes, np.uint32(32))[keep], doc[keep]
    has[doc[codes != 32]] = True
    keys = np.zeros(0, np.uint32)
    for start in range(0, len(codes), PIECE):  # pieces share NGRAMS - 1 characters, so that no n-gram is lost between them
        piece = _places(codes[start : start + PIECE + NGRAMS - 1], doc[start : start + PIECE + NGRAMS - 1])
        keys = piece if not len(keys) else _distinct(np.concatenate([keys, piece]))
    return keys & np.uint32(SPACE - 1), np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(SPACE_BITS)), has


def _rows(batch: pa.RecordBatch) -> Iterator[list[str | None]]:
    """The texts of a batch, as many at a time as `presence` takes."""
    for block in blocks(batch, "text", ROW_BYTES):
        for start in range(0, block.num_rows, ROWS):
            yield block.column("text").slice(start, ROWS).to_pylist()


def _index(places: np.ndarray) -> np.ndarray:
    """For each place of SPACE its number in a list of places, from 1 (0: not there)."""
    at = np.zeros(SPACE, np.int32)
    at[places] = np.arange(1, len(places) + 1)
    return at


class Marks:
    """Landmarks as the lists of the landmarks that have each of their places; for kernel values with them."""

    def __init__(self, marks: list[np.ndarray]):
        self.marks, self.size = marks, np.array([len(m) for m in marks], np.int64)
        each = np.concatenate(marks) if marks else np.zeros(0, np.uint32)
        self.places, self.at = np.unique(each, return_inverse=True)
        self.owner = np.repeat(np.arange(len(marks)), self.size)
        order = np.argsort(self.at, kind="stable")
        self.sorted_owner, self.first = self.owner[order], np.searchsorted(self.at[order], np.arange(len(self.places) + 1))

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (their places) with all landmarks."""
        index, out = _index(self.places), np.zeros((len(texts), len(self.marks)))
        for i, places in enumerate(texts):
            at = index[places]
            at = at[at > 0] - 1
            many = self.first[at + 1] - self.first[at]
            entries = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out[i] = np.bincount(self.sorted_owner[entries], minlength=len(self.marks)) / np.sqrt(max(len(places), 1) * np.maximum(self.size, 1))
        return out

    def folded(self, weights: np.ndarray) -> Table:
        """The landmarks' unit rows times a row of weights for each."""
        share = weights / np.sqrt(np.maximum(self.size, 1))[:, None]
        table = np.zeros((len(self.places) + 1, weights.shape[1]), np.float32)
        for j in range(weights.shape[1]):
            table[1:, j] = np.bincount(self.at, weights=share[self.owner, j], minlength=len(self.places))
        return Table(self.places.astype(np.uint32), table)


class Table:
    """A matrix of places by languages; its first row is for all other places."""

    def __init__(self, places: np.ndarray, weights: np.ndarray):
        self.places, self.weights, self.index = places, weights, None

    def times(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The product of sparse unit rows of presence with the matrix."""
        if self.index is None:
            self.index = _index(self.places)
        at = self.index[places]
        on = at > 0
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[on]
        picked = self.weights[at[on]]
        out = np.stack([np.bincount(row, weights=picked[:, j], minlength=len(offsets) - 1) for j in range(picked.shape[1])], axis=1)
        return out / np.sqrt(np.maximum(np.diff(offsets), 1))[:, None]

    def __getstate__(self):
        return self.__dict__ | {"index": None}


@dataclass
class StringKernel:
    """Languages, and the landmarks' places with a weight for each language."""

    names: list[str]
    table: Table

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of at most ROWS texts."""
        places, offsets, has = presence(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        value = self.table.times(places, offsets)
        best = value.argmax(axis=1)
        return [self.names[b] if h else "und" for b, h in zip(best, has)], np.where(has, np.clip((value.max(axis=1, initial=-1) + 1) / 2, 0, 1), 0.0)


def fit(marks: Marks, kernel: np.ndarray, langs: list[str]) -> StringKernel:
    """Fit on landmarks, the kernel values of the sample with them (rows) and the sample's languages."""
    names = sorted(set(langs))
    if not names or not marks.marks:
        return StringKernel([], Table(np.zeros(0, np.uint32), np.zeros((1, 0), np.float32)))
    own = marks.kernel(marks.marks)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    on = values > 1e-6 * values.max()
    root = vectors[:, on] / np.sqrt(values[on])  # Nyström map: kernel values to features
    z = kernel @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    weights = np.linalg.solve(z.T @ z + RIDGE * np.eye(z.shape[1]), z.T @ target)
    return StringKernel(names, marks.folded(root @ weights))


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> StringKernel:
    """Fit on at most `sample` documents with text and lang whose doc_id's CRC-32 is not 2 modulo 4."""
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null").where(crc32_of("doc_id") % 4 != 2)
    keyed = usable.select("text", "lang", F.xxhash64("text", "doc_id").alias("key"))
    # only keys are sorted; texts are read where they are
    edge = keyed.select("key").orderBy("key").limit(sample).agg(F.max("key").alias("k")).first()["k"]
    if edge is None:
        return fit(Marks([]), np.zeros((0, 0)), [])
    chosen = materialise(keyed.where(F.col("key") <= edge).orderBy("key", "lang", F.xxhash64("text")).limit(sample), "op8-sample")
    # landmarks go round the languages, so that rare ones have some
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    first = chosen.withColumn("turn", turn).orderBy("turn", "lang").limit(landmarks)

    def thinned(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.sort(presence([t])[0])[:MARK_GRAMS].astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("turn"), batch.column("lang"), pa.array(rows, pa.binary())], ["turn", "lang", "places"])

    found = map_text(first, thinned, "turn int, lang string, places binary").orderBy("turn", "lang").collect()
    marks = [np.frombuffer(bytes(r.places), "<u4") for r in found]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, values = Marks(marks), []
        for texts in _rows(batch):
            places, offsets, _ = presence(texts)
            values += [v.tobytes() for v in own.kernel([places[a:b] for a, b in zip(offsets[:-1], offsets[1:])])]
        return pa.record_batch([batch.column("key"), batch.column("lang"), pa.array(values, pa.binary())], ["key", "lang", "kernel"])

    rows = sorted(map_text(chosen, kernel, "key long, lang string, kernel binary").collect())  # in an order that does not depend on tasks
    return fit(Marks(marks), np.frombuffer(b"".join(bytes(r.kernel) for r in rows), "<f8").reshape(len(rows), -1), [r.lang for r in rows])


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(docs, sample)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = [], []
        for texts in _rows(batch):
            lang, score = model.predict(texts)
            names += lang
            scores.append(score)
        return pa.record_batch([batch.column("k0"), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["k0", "lang_pred", "score"])

    slim, carried, back = numbered(docs, ["doc_id"])
    out = map_text(slim, kernel, fields(slim, carried, "lang_pred string, score double"))
    return out.select(*back, "lang_pred", "score").select("doc_id", (crc32_of("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")
