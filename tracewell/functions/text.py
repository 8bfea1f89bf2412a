"""Text metrics and predicates as column expressions. Words are runs of characters other than ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[^ \\t\\n\\r\\f\\x0B]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\n[ \\t\\n\\r]*\\n"), lambda p: p.rlike("[^ \\t\\n\\r]"))).cast("long")


def count_lines(text: Column) -> Column:
    """Lines with something on them."""
    return F.size(lines(text)).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\n"), lambda x: F.regexp_replace(x, "^[ \\t\\r]+|[ \\t\\r]+$", "")), lambda x: x != "")


def unique_word_ratio(text: Column) -> Column:
    """Distinct over all words in lower case; null without words."""
    # the words are bound once by the lambda; written three times they would be split three times
    return F.element_at(F.transform(F.array(words(F.lower(text))), lambda w: F.when(F.size(w) > 0, F.round(F.size(F.array_distinct(w)) / F.size(w), 6))), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-cased words; 1 if both are empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(x, y)) / union, 6))


def longest_duplicate_run(text: Column) -> Column:
    """Length of the longest run of equal neighbouring lines (trimmed, not empty); 0 without lines."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def step(acc: Column, line: Column) -> Column:
        run = F.when(line == acc["last"], acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(line.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(lines(text), start, step, lambda acc: acc["best"])


def ngram_text(text: Column) -> Column:
    """A text in lower case with nothing but ASCII alphanumeric characters and white space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 \\t\\n\\r]", "")


def word_ngrams(text: Column, n: int = 3) -> Column:
    """n-grams of the lower-cased ASCII alphanumeric words, joined by a space."""
    found = F.filter(F.split(ngram_text(text), "[ \\t\\n\\r]+"), lambda x: x != "")

    def grams(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # the words are bound once by the outer lambda; written twice they would be split again for each gram
    return F.element_at(F.transform(F.array(found), grams), 1)


def tokens_estimate(text: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def url_well_formed(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://[A-Za-z0-9.-]+\\.[A-Za-z]{2,}(:[0-9]+)?([/?#][^ ]*)?\\z"), F.lit(False)).cast("int")
