"""Repetition inside a text: near-equal segments, cycles of lines, and blocks written three times in a row.

Segments are cut by column expressions. What depends on their order runs in Arrow batches, one row at a time, since it is a
fold over the segments of one text.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from tracewell.functions import text as T
from tracewell.functions.completeness import trimmed

#: Similarity of near-equal segments, and the shortest segments that count.
SIMILARITY, MIN_SENTENCE, MIN_LINE = 0.85, 20, 5
MAX_CYCLE = 10


def _cut(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), trimmed), lambda s: s != "")


def sentences(text: Column) -> Column:
    return _cut(text, "(?<=[.!?])\\s+")


def paragraphs(text: Column) -> Column:
    return _cut(text, "\\n\\s*\\n")


def segments(text: Column) -> Column:
    """Paragraphs of a text of over 2000 characters with more than three of them, else sentences; those of 20 characters or more."""
    found = F.when((F.length(text) > 2000) & (F.size(paragraphs(text)) > 3), paragraphs(text)).otherwise(sentences(text))
    return F.filter(found, lambda s: F.length(s) >= MIN_SENTENCE)


def _plain(s: str) -> str:
    return " ".join(s.lower().split())


def _similar(a: str, b: str) -> bool:
    """Equal, or of like length (a cheap test first) and with a Jaccard likeness of words over the threshold."""
    if a == b:
        return True
    if min(len(a), len(b)) < 0.7 * SIMILARITY * max(len(a), len(b)):
        return False
    x, y = set(a.split()), set(b.split())
    return len(x & y) >= SIMILARITY * len(x | y)


def repeated(found: list[str]) -> dict[str, float | int]:
    """Every segment joins the first class whose first member it resembles. An index of exact texts spares the search for copies: a copy joins where its equal did. Others are compared only with first members that share one of their rarest words with
    them, as two texts so alike must: of m words in a fixed order the first m - SIMILARITY m + 1 of both have one in common. Words go by the number of different segments that hold them, so a word of most segments is hardly ever looked up."""
    heads: list[tuple[str, int]] = []
    counts: list[int] = []
    home: dict[str, int] = {}
    by_word: dict[str, list[int]] = {}
    keys = [_plain(s) for s in found]
    often = Counter(w for key in set(keys) for w in set(key.split()))

    def leading(key: str) -> list[str]:
        words = sorted(set(key.split()), key=lambda w: (often[w], w))
        return words[: len(words) - math.ceil(SIMILARITY * len(words) - 1e-9) + 1]

    for s, key in zip(found, keys):
        at = home.get(key)
        if at is None:
            first = leading(key)
            at = next((i for i in sorted({i for w in first for i in by_word.get(w, ())}) if _similar(key, heads[i][0])), None)
            if at is None:
                at = len(heads)
                heads.append((key, len(s)))
                counts.append(0)
                for w in first:
                    by_word.setdefault(w, []).append(at)
            home[key] = at
        counts[at] += 1
    extra = sum(n - 1 for n in counts)
    chars = sum((n - 1) * length for n, (_, length) in zip(counts, heads, strict=True))
    total = sum(map(len, found))
    ratio = min(1.0, chars / total) if total else 0.0
    score = min(1.0, 0.6 * ratio + 0.4 * extra / len(found)) if found else 0.0
    return {"score": round(score, 6), "ratio": round(ratio, 6), "unique": len(heads), "total": len(found)}


def cycles(found: list[str]) -> dict[str, float | int]:
    """Runs of lines that repeat right after themselves, long cycles before short ones; starts inside a run found before are passed over."""
    plain = [_plain(s) for s in found]
    same: dict[tuple[str, str], bool] = {}

    def like(i: int, j: int) -> bool:
        pair = (plain[i], plain[j])
        if pair[0] == pair[1]:
            return True
        if pair not in same:
            same[pair] = _similar(*pair)
        return same[pair]

    n, taken, loops, covered, longest = len(plain), set(), 0, 0, 0
    for size in range(min(MAX_CYCLE, n // 2), 0, -1):
        for start in range(n - 2 * size + 1):
            if start in taken:
                continue
            end = start + size
            while end + size <= n and all(like(start + k, end + k) for k in range(size)):
                end += size
            times = (end - start) // size
            if times >= 2:
                taken.update(range(start, end))
                loops, covered, longest = loops + 1, covered + end - start, max(longest, times)
    return {"loops": loops, "longest": longest, "ratio": round(min(1.0, covered / n), 6) if n else 0.0}


def tripled(s: str, least: int = 50) -> bool:
    """A block of at least `least` characters on one line or more that is written three times in a row.

    Such a block of length p makes the text equal to itself moved by p, over 2p characters at least, which hold a multiple of p; so for each p only its multiples are looked at, where the next `least` characters must be
    the same one multiple on. That is n / p looks for a length, n log n in all. What passes is measured to both sides by bisection on hashes, many places at once, and compared character by character at the end.
    """
    n = len(s)
    if n < 3 * least:
        return False
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = _Hashes(codes)
    grams = hashes.of(np.arange(n - least + 1), least)
    root = max(least, math.isqrt(n))
    # short lengths one by one, their multiples together; long ones together, one multiple after another
    looks = [(np.full(1, p), None) for p in range(least, min(root, n // 3) + 1)]
    looks += [(np.arange(root + 1, min(n // 3, (len(grams) - 1) // (k + 1)) + 1), k) for k in range(n // (root + 1) + 1)]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lengths, k in looks:
        if k is None:
            own = grams[:: int(lengths[0])]
            at = np.flatnonzero(own[1:] == own[:-1]) * lengths[0]
            lengths = np.repeat(lengths, len(at))
        else:
            lengths = lengths[grams[lengths * k] == grams[lengths * (k + 1)]]
            at = lengths * k
        if len(at):
            held.append((at, lengths))
        if sum(len(a) for a, _ in held) > 50_000:
            if _thrice(codes, hashes, held):
                return True
            held = []
    return _thrice(codes, hashes, held)


def _thrice(codes: np.ndarray, hashes: _Hashes, held: list[tuple[np.ndarray, np.ndarray]]) -> bool:
    """At some of these places the text equals itself moved by the length there, over twice that length."""
    if not held:
        return False
    at, p = (np.concatenate(x) for x in zip(*held))
    right = hashes.same(at, at + p, np.minimum(2 * p, len(codes) - at - p), 1)
    left = hashes.same(at, at + p, np.minimum(2 * p, at), -1)
    for a, length in zip(*(x[left + right >= 2 * p].tolist() for x in (at - left, p))):
        if np.array_equal(codes[a : a + 2 * length], codes[a + length : a + 3 * length]):
            return True
    return False


class _Hashes:
    """64-bit hashes of any runs of characters, from sums of powers."""

    def __init__(self, codes: np.ndarray):
        step = 0x9E3779B97F4A7C15
        powers, self.back = np.full(len(codes), step, np.uint64), np.full(len(codes) + 1, pow(step, -1, 1 << 64), np.uint64)
        powers[0] = self.back[0] = 1
        self.back = np.cumprod(self.back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers))])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def same(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many characters from a and b on (way 1) or before them (-1) are equal, `most` at most."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            back = middle if way < 0 else 0
            equal = self.of(a - back, middle) == self.of(b - back, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low


@F.pandas_udf(StructType().add("score", DoubleType()).add("ratio", DoubleType()).add("unique", LongType()).add("total", LongType()))
def _repetition(found: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repeated(list(x)) for x in found], columns=["score", "ratio", "unique", "total"])


@F.pandas_udf(StructType().add("loops", LongType()).add("longest", LongType()).add("ratio", DoubleType()))
def _loops(found: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cycles(list(x)) for x in found], columns=["loops", "longest", "ratio"])


@F.pandas_udf(BooleanType())
def _tripled(text: pd.Series) -> pd.Series:
    return text.map(tripled)


#: Fixed: the most frequent trigrams that count.
MOST_GRAMS = 5


@F.pandas_udf(StructType().add("most", LongType()).add("unique", LongType()).add("total", LongType()))
def gram_counts(texts: pd.Series) -> pd.DataFrame:
    """How often the most frequent word trigrams of some texts (ngram_text) together occur, how many different ones and how many in all there are."""
    rows = []
    for some in texts:
        counts: Counter = Counter()
        for text in some:
            words = text.split()
            counts.update(zip(words, words[1:], words[2:]))
        rows.append((sum(heapq.nlargest(MOST_GRAMS, counts.values())), len(counts), counts.total()))
    return pd.DataFrame(rows, columns=["most", "unique", "total"])


def repetition(text: Column) -> Column:
    """(score, ratio, unique, total) of a text's segments."""
    return _repetition(segments(text))


def loops(text: Column) -> Column:
    """(loops, longest, ratio) of a text's lines of five characters or more."""
    return _loops(F.filter(T.lines(text), lambda s: F.length(s) >= MIN_LINE))


def tripled_block(text: Column) -> Column:
    return _tripled(F.coalesce(text, F.lit("")))


#: Fixed: shares of segments, loops and trigrams in the whole score, and the score from which a text is repetitive.
SHARES, REPETITIVE = (0.35, 0.4, 0.25), 0.3


def full_repetition(df: DataFrame, saturation: DataFrame, item: str, text: str = "text") -> DataFrame:
    """(item, score, repetitive): segments, loops and the saturation of trigrams (item, score) together."""
    parts = df.select(item, repetition(F.col(text))["score"].alias("segments"), loops(F.col(text))["ratio"].alias("loops")).join(saturation.select(item, F.col("score").alias("grams")), item, "left")
    whole = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in zip(("segments", "loops", "grams"), SHARES)), F.lit(0.0))
    score = F.least(F.lit(1.0), whole)
    return parts.select(item, F.round(score, 6).alias("score"), (score >= REPETITIVE).cast("int").alias("repetitive"))
