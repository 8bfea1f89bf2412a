"""Assertions on a text, as rows (assertion, status). A null text fails all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(text: Column, part: str, ignore_case: bool = False) -> Column:
    return F.lower(text).contains(part.lower()) if ignore_case else text.contains(part)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def length_between(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def keyword_coverage(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords that the text contains, in any case."""
    return F.round(sum((F.coalesce(contains(text, k, True), F.lit(False)).cast("int") for k in keywords), F.lit(0)) / len(keywords), 6)


def assert_all(df: DataFrame, item: str, rules: dict[str, Column]) -> DataFrame:
    """(item, assertion, status): one row for each rule."""
    results = F.array(*(F.struct(F.lit(name).alias("assertion"), F.when(F.coalesce(rule, F.lit(False)), "pass").otherwise("fail").alias("status")) for name, rule in rules.items()))
    return df.select(item, F.explode(results).alias("r")).select(item, "r.assertion", "r.status")


def negated(rules: dict[str, Column]) -> dict[str, Column]:
    """The opposite of each rule, under "not " and its name; a text that is null fails these too."""
    return {f"not {name}": ~rule for name, rule in rules.items()}


def equals(text: Column, other: str) -> Column:
    return text == F.lit(other)


def same_json(text: Column, other: str) -> Column:
    """Both are JSON of one value, whatever their white space and order of keys."""
    plain = lambda c: F.to_json(F.try_parse_json(c))
    return plain(text) == plain(F.lit(other))
