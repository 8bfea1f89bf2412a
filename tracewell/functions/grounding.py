"""An answer against its task or its references: relevance of terms, and how far its sentences are found in a reference."""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from tracewell.functions import patterns as P
from tracewell.functions.completeness import SPACE, any_of, trimmed

#: ln(3/2) + 1: the weight of a term that only one of two texts has; a term of both weighs 1.
UNSHARED = 1.4054651081081644


def stem(word: Column) -> Column:
    """A word without its ending; words of up to three letters stay."""
    out = word
    for ending, least, tail, undouble in reversed(P.STEM):
        base = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(tail))
        if undouble:
            base = F.when((F.length(base) > 2) & (F.substring(base, -1, 1) == F.substring(base, -2, 1)), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
        out = F.when(word.endswith(ending) & (F.length(word) >= max(least, 4)), base).otherwise(out)
    return out


def terms(text: Column) -> Column:
    """Stems of words of two characters or more, without stop words and numbers of up to three digits, and pairs of neighbouring stems."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*P.STOPWORDS) & ~w.rlike("^\\d{1,3}\\z"))

    def with_pairs(s: Column) -> Column:
        pairs = F.when(F.size(s) >= 2, F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.concat_ws(" ", F.element_at(s, i), F.element_at(s, i + 1)))).otherwise(F.array().cast("array<string>"))
        return F.concat(s, pairs)

    # bound once by the outer lambda, so that the stems are not computed again for each pair
    return F.element_at(F.transform(F.array(F.transform(kept, stem)), with_pairs), 1)


def relevance(df: DataFrame, item: str, task: str = "task", answer: str = "answer") -> DataFrame:
    """(item, relevance): cosine of the term weights of task and answer; 0 if either has no terms.

    Both aggregations are by `item` and need no shuffle beyond the one that brought a pair together.
    """
    sides = F.array(F.struct(F.lit(1).alias("t"), terms(F.col(task)).alias("terms")), F.struct(F.lit(0).alias("t"), terms(F.col(answer)).alias("terms")))
    long = df.select(item, F.explode(sides).alias("s")).select(item, "s.t", F.explode_outer("s.terms").alias("term"))
    n = long.groupBy(item, "term").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("t")).otherwise(0)).alias("a"), F.sum(F.when(F.col("term").isNotNull(), 1 - F.col("t")).otherwise(0)).alias("b"))
    w = F.when((F.col("a") > 0) & (F.col("b") > 0), 1.0).otherwise(UNSHARED)
    # lengths of the texts cancel out of the cosine
    out = n.groupBy(item).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.pow(F.col("a") * w, F.lit(2))).alias("na"), F.sum(F.pow(F.col("b") * w, F.lit(2))).alias("nb"))
    return out.select(item, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.round(F.col("dot") / F.sqrt(F.col("na") * F.col("nb")), 6)).otherwise(0.0).alias("relevance"))


def content_words(text: Column) -> Column:
    """Distinct lower-cased words of more than two characters, ASCII only."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct words; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def claims(text: Column) -> Column:
    """Sentences of over ten characters outside code that state something."""
    plain = F.regexp_replace(F.regexp_replace(text, P.FENCED_CODE, " "), P.INLINE_CODE, " ")
    parts = F.filter(F.transform(F.split(plain, P.CLAIM_END), trimmed), lambda s: F.length(s) > 10)
    return F.filter(parts, lambda s: ~any_of(s, P.NON_CLAIM))


def contradicts(claim: Column, reference: Column, likeness: Column) -> Column:
    """Numbers of the two, in like words, lie over 30 % apart."""
    numbers = [F.transform(F.regexp_extract_all(x, F.lit("\\d+(?:\\.\\d+)?"), F.lit(0)), lambda n: n.try_cast("double")) for x in (claim, reference)]
    return (likeness >= 0.4) & F.exists(numbers[0], lambda a: F.exists(numbers[1], lambda b: (a != b) & (F.abs(a - b) / F.greatest(a, b, F.lit(1.0)) > 0.3)))


#: What a claim has besides its text: places in characters from 0, kind, and how sure its pattern is.
_CLAIMS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", StringType()).add("confidence", DoubleType()).add("claim", StringType()))


#: Texts that are looked through at once.
PIECE = 256
_ENDS = re.compile(r"[.!?\n]")
_CLAIM_END = re.compile(P.CLAIM_END, re.ASCII)


def _any_match(values: pa.Array, patterns: list[str]) -> np.ndarray:
    found = np.zeros(len(values), bool)
    for pattern in patterns:
        found |= pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)
    return found


def _across(text: str, sign: re.Pattern) -> list[str]:
    """Stretches around a sign that may hold ends of sentences: from the end before it, or the last stretch's end, to the end after it."""
    out, at = [], 0
    while found := sign.search(text, at):
        start = max(at, 1 + max(text.rfind(end, at, found.start()) for end in ".!?\n"))
        end = _ENDS.search(text, found.end())
        at = end.start() if end else len(text)
        out.append(text[start:at])
    return out


def _extracted(texts: pa.Array, kinds: frozenset[str] | None, least: float, code: bool, most: float) -> pa.Array:
    """_CLAIMS of a batch of texts. Patterns run over all stretches between ends of sentences of the batch at once; only texts in which a sign may hold such an end are searched one by one."""
    texts = pc.fill_null(texts, "")
    source = texts if code else pc.replace_substring_regex(pc.replace_substring_regex(texts, P.FENCED_CODE, " "), P.INLINE_CODE, " ")
    plain = texts.to_pylist()
    listed = pc.split_pattern_regex(source, r"[.!?\n]")
    own = np.repeat(np.arange(len(texts)), listed.value_lengths().to_numpy(zero_copy_only=False))
    cells = pc.utf8_trim(listed.flatten(), characters=SPACE)
    long = pc.greater_equal(pc.utf8_length(cells), 15).to_numpy(zero_copy_only=False)
    own, cells = own[long], cells.filter(pa.array(long))
    stated = ~_any_match(cells, P.NON_CLAIM)
    own, cells = own[stated], cells.filter(pa.array(stated))
    taken: list[list[tuple]] = [[] for _ in plain]

    def place(doc: int, claim: str, kind: str, sure: float) -> None:
        """Takes a claim at its first place in the text, if it is there and overlaps none taken before. Taken spans are disjoint and kept sorted, so a span meets its two neighbours only."""
        start = plain[doc].find(claim)
        spans, end = taken[doc], start + len(claim)
        if start < 0 or len(spans) >= most:
            return
        at = bisect.bisect(spans, (start, end))
        if (at == 0 or spans[at - 1][1] <= start) and (at == len(spans) or end <= spans[at][0]):
            spans.insert(at, (start, end, kind, sure, claim))

    for kind, sign, sure in P.CLAIM_KINDS:
        if sure < least or kinds is not None and kind not in kinds:
            continue
        holds = P.SIGN_ACROSS.get(kind)
        across = pc.match_substring_regex(source, holds).to_numpy(zero_copy_only=False) if holds else np.zeros(len(texts), bool)
        hits = pc.match_substring_regex(cells, sign).to_numpy(zero_copy_only=False) & ~across[own]
        for doc, claim in zip(own[hits].tolist(), cells.filter(pa.array(hits)).to_pylist()):
            place(doc, claim, kind, sure)
        found = [(doc, claim.strip(SPACE)) for doc in np.flatnonzero(across).tolist() for claim in _across(source[doc].as_py(), re.compile(sign, re.ASCII))]
        found = [x for x in found if len(x[1]) >= 15]
        fine = ~_any_match(pa.array([c for _, c in found], pa.string()), P.NON_CLAIM)
        for (doc, claim), ok in zip(found, fine.tolist()):
            if ok:
                place(doc, claim, kind, sure)
    parts = [(doc, s) for doc, text in enumerate(source.to_pylist()) for x in _CLAIM_END.split(text) if 20 <= len(s := x.strip(SPACE)) <= 500]
    sentences = pa.array([s for _, s in parts], pa.string())
    fine = _any_match(sentences, [P.FACTUAL]) & ~_any_match(sentences, [P.POINTING, *P.NON_CLAIM])
    for (doc, claim), ok in zip(parts, fine.tolist()):
        if ok:
            place(doc, claim, "factual", 0.5)
    flat = [x for spans in taken for x in spans]
    columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()))]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, taken)]).astype(np.int32)), pa.StructArray.from_arrays(columns, names=_CLAIMS.elementType.names))


def typed_claims(text: Column, kinds: list[str] | None = None, least: float = 0.5, code: bool = False, most: int | None = None) -> Column:
    """_CLAIMS: the claims of a text by their kinds. The patterns are tried in turn and a span that overlaps one found before goes; a span runs from the end of the sentence before (or of the match before) to the next one's beginning. At the end come sentences that look factual.
    kinds, least: patterns that count, by name and by confidence; code: code blocks count too; most: only so many claims, the first found."""
    chosen, limit = None if kinds is None else frozenset(kinds), math.inf if most is None else most

    def run(texts: pa.Array) -> pa.Array:
        # piece by piece: a batch's stretches, matches and spans need many times the memory of its texts
        return pa.concat_arrays([_extracted(texts.slice(i, PIECE), chosen, least, code, limit) for i in range(0, max(1, len(texts)), PIECE)])

    return F.arrow_udf(run, _CLAIMS)(text)


_CONTENT = re.compile("[a-z0-9_]{3,}")
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")


class _Swept:
    """A reference as an inverted list of the places of its content words. A claim's words mark the windows they stand in by running counts, so a claim costs its words' places and one number a window, not each window's words."""

    def __init__(self, reference: str):
        self.words = _WHITE.split(reference)
        self.places: dict[str, np.ndarray] = {}
        listed: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for c in _CONTENT.findall(w.lower()):
                own = listed.setdefault(c, [])
                if not own or own[-1] != i:
                    own.append(i)
        self.places = {c: np.array(own) for c, own in listed.items()}
        self.sizes: dict[int, np.ndarray] = {}

    def _marks(self, places: np.ndarray, n: int, step: int, count: np.ndarray) -> None:
        """Adds one to the running count of each window that holds one of the places, for its first place in it."""
        before = np.concatenate([[-1], places[:-1]])
        first = np.maximum(-(-(places - n + 1) // step), before // step + 1)
        last = np.minimum(places // step, len(count) - 2)
        some = (first := np.maximum(first, 0)) <= last
        np.add.at(count, first[some], 1)
        np.add.at(count, last[some] + 1, -1)

    def best(self, claim: str, window: int) -> tuple[float, str]:
        """Likeness and words of the window most like a claim; of equals the first."""
        n = max(len(_WHITE.split(claim)) * 2, -(-window // 5))
        step = max(1, n // 3)
        windows = max(0, len(self.words) - n) // step + 1
        if n not in self.sizes:
            size = np.zeros(windows + 1, np.int64)
            for places in self.places.values():
                self._marks(places, n, step, size)
            self.sizes[n] = np.cumsum(size)[:-1]
        own = set(_CONTENT.findall(claim.lower()))
        both = np.zeros(windows + 1, np.int64)
        for places in (self.places[c] for c in own if c in self.places):
            self._marks(places, n, step, both)
        both = np.cumsum(both)[:-1]
        likeness = np.where(both > 0, both / np.maximum(len(own) + self.sizes[n] - both, 1), 0.0)
        at = int(likeness.argmax())
        return (float(likeness[at]), " ".join(self.words[at * step : at * step + n])) if likeness[at] > 0 else (0.0, "")


@F.pandas_udf(ArrayType(StructType().add("likeness", DoubleType()).add("passage", StringType())))
def _swept(claims_of: pd.Series, references: pd.Series, windows: pd.Series) -> pd.Series:
    out = []
    for listed, reference, window in zip(claims_of, references, windows):
        swept = _Swept(reference) if len(listed) else None
        out.append([dict(zip(("likeness", "passage"), swept.best(c, window))) for c in listed])
    return pd.Series(out, dtype=object)


def verified(df: DataFrame, item: str, answer: str = "answer", reference: str = "reference", window: int = 500, typed: bool = False) -> DataFrame:
    """(item, claim, likeness, status): each claim of an answer against the best window of words of its reference; typed: claims by their kinds (typed_claims) and a column kind, else whole sentences.

    Windows are twice as long as the claim, or window / 5 words if that is more, and start a third of their length apart.
    An item stays one row until its claims are judged: its reference is indexed once, and nothing is shuffled or copied for each claim.
    """
    listed = typed_claims(F.col(answer)) if typed else F.transform(claims(F.col(answer)), lambda c: F.struct(F.lit(None).cast("string").alias("kind"), c.alias("claim")))
    c = df.select(item, F.coalesce(F.col(reference), F.lit("")).alias("_ref"), listed.alias("_claims")).where(F.size("_claims") > 0)
    c = c.withColumn("_near", _swept(F.transform("_claims", lambda x: x["claim"]), "_ref", F.lit(window)))

    def status(claim: Column, kind: Column, near: Column) -> Column:
        exact = F.lower("_ref").contains(F.lower(claim))
        likeness = F.when(exact, 1.0).otherwise(near["likeness"])
        wrong = contradicts(claim, near["passage"], near["likeness"])
        verdict = (
            F.when(claim.rlike(P.SELF_REFERENCE), "unverifiable")
            .when(F.col("_ref") == "", "unverifiable")
            .when(likeness >= 0.8, "grounded")
            .when(likeness >= 0.4, F.when(wrong, "contradicted").when(likeness >= 0.7, "grounded").otherwise("partial"))
            .otherwise("ungrounded")
        )
        return F.struct(claim.alias("claim"), kind.alias("kind"), F.round(likeness, 6).alias("likeness"), verdict.alias("status"))

    judged = F.zip_with("_claims", "_near", lambda x, near: status(x["claim"], x["kind"], near))
    out = c.select(item, F.explode(judged).alias("c")).select(item, "c.*")
    return out if typed else out.drop("kind")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hallucination(claims_checked: DataFrame, item: str) -> DataFrame:
    """(item, claims, grounded, partial, ungrounded, contradicted, score, grounded_share): the mean weight of what could be checked; 0 and null if nothing could."""
    n = {s: F.count_if(F.col("status") == s) for s in ("grounded", "partial", "ungrounded", "contradicted")}
    weight = F.when(F.col("status") == "contradicted", 1.0).when(F.col("status") == "ungrounded", 0.8).when(F.col("status") == "partial", 0.3).when(F.col("status") == "grounded", 0.0)
    held = F.when(F.col("status").isin("grounded", "partial"), 1.0).when(F.col("status") != "unverifiable", 0.0)
    return claims_checked.groupBy(item).agg(F.count("*").alias("claims"), *(c.alias(s) for s, c in n.items()), F.round(F.coalesce(F.avg(weight), F.lit(0.0)), 6).alias("score"), F.round(F.avg(held), 6).alias("grounded_share"))
