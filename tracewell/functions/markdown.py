"""Structure of Markdown texts: fenced blocks, headings outside them, and rules about both. A null text is an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A block between two fences; the last may stay open. The group is its language.
FENCED = "(?m)^(?:`{3,}|~{3,})([^\\s]*)[^\\n]*(?:\\n[\\s\\S]*?(?:^(?:`{3,}|~{3,})[^\\n]*$|\\z)|\\z)"
HEADING = "(?m)^(#{1,6})[ \\t]+([^\\n]+?)(?:[ \\t]+#+)?[ \\t]*$"


def code_languages(text: Column) -> Column:
    """Language of each fenced block, in lower case; empty if it names none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FENCED), F.lit(1)), F.lower)


def outside_code(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), FENCED, "")


def heading_levels(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(outside_code(text), F.lit(HEADING), F.lit(1)), F.length)


def heading_texts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(outside_code(text), F.lit(HEADING), F.lit(2)), lambda h: F.lower(F.trim(h)))


def level_skips(text: Column) -> Column:
    """How often a heading lies more than one level below the one before it."""
    levels = heading_levels(text)
    return F.size(F.filter(F.zip_with(levels, F.concat(F.slice(levels, 1, 1), levels), lambda a, b: a - b), lambda d: d > 1))


def missing_sections(text: Column, required: list[str]) -> Column:
    """Required headings, in any case, that a text lacks."""
    return F.array_except(F.array(*(F.lit(s.lower()) for s in required)), heading_texts(text))
