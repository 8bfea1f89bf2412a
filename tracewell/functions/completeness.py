"""Is a text a whole answer? Sentence counts, stubs, truncation, abandonment, and violations by severity. A null text is an empty one."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions import text as T
from tracewell.functions.schemas import json_valid

#: ASCII's white space, and what RE2 has as such: a vertical tab is none.
SPACE, BLANK = " \t\n\x0b\f\r", " \t\n\f\r"


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))


def right_trimmed(text: Column) -> Column:
    return F.rtrim(F.coalesce(text, F.lit("")), F.lit(BLANK))


def says(text: Column, pattern: str) -> Column:
    return text.rlike(P.java(pattern))


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(or_, (says(text, p) for p in patterns))


def count_sentences(text: Column) -> Column:
    """Ends of sentences, not counting those of abbreviations, decimals and ellipses; one for other texts with something in them."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), P.java(P.ABBREVIATION), "ABBR"), "\\d+\\.\\d+", "NUM"), "\\.{2,}", "ELLIPSIS")
    ends = F.size(F.regexp_extract_all(plain, F.lit(P.java("[.!?]+(?:\\s|\\z)")), F.lit(0)))
    return F.when(ends > 0, ends).when(trimmed(text) != "", 1).otherwise(0).cast("long")


def is_truncated(text: Column) -> Column:
    return any_of(right_trimmed(text), P.TRUNCATED)


def is_stub(text: Column) -> Column:
    t = trimmed(text)
    return ((F.length(t) < 20) & ~says(t, P.SHORT_ANSWER)) | any_of(t, P.STUB)


def last_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(T.lines(text), F.lit(-1)), F.lit(""))


def brackets_balanced(text: Column) -> Column:
    """Brackets outside quotations close in the order they were opened. Only quotes and brackets are folded over; the state is the open brackets and the open quote."""
    marks = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "\\\\[\"'`]", ""), F.lit("[\\[\\](){}\"'`]"), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("quote"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        quoted, is_quote, opens = acc["quote"] != "", c.isin('"', "'", "`"), c.isin("(", "[", "{")
        closer = F.translate(c, ")]}", "([{")
        matches = F.substring(acc["open"], -1, 1) == closer
        shorter = F.substring(acc["open"], F.lit(1), F.length(acc["open"]) - 1)
        skip = quoted | is_quote | ~acc["ok"]
        return F.struct(
            F.when(skip, acc["open"]).when(opens, F.concat(acc["open"], c)).otherwise(shorter).alias("open"),
            F.when(quoted, F.when(c == acc["quote"], "").otherwise(acc["quote"])).when(is_quote, c).otherwise("").alias("quote"),
            F.when(skip | opens, acc["ok"]).otherwise(matches).alias("ok"),
        )

    return F.aggregate(marks, start, step, lambda acc: acc["ok"] & (acc["open"] == ""))


def incomplete_ending(text: Column, words: Column | None = None) -> Column:
    """More than 50 words, and the last line is neither a finished sentence nor a list item, heading or fence."""
    last = last_line(text)
    return ((T.count_words(text) if words is None else words) > 50) & ~last.rlike("[.!?:;)\\]}`\"']\\z") & ~says(last, "^(?:[-*•]\\s|\\d+[.)]\\s|#{1,6}\\s|```)")


def violations(text: Column, words: Column | None = None, sentences: Column | None = None) -> Column:
    """Array of (category, rule, severity). An empty text has only the violation of being empty. Counts that are columns already need not be made again."""
    words = T.count_words(text) if words is None else words
    sentences = count_sentences(text) if sentences is None else sentences
    fillers = sum((F.lower(text).contains(p).cast("int") for p in P.FILLER), F.lit(0))
    rules = [
        ("substance", "stub", "error", is_stub(text)),
        ("substance", "repetition", "warning", (words > 10) & (T.unique_word_ratio(text) < 0.3)),
        ("substance", "duplicate_lines", "warning", T.longest_duplicate_run(text) > 3),
        ("substance", "short_sentences", "warning", (sentences > 2) & (words / sentences < 3)),
        ("substance", "filler", "warning", fillers >= 3),
        ("structure", "brackets", "warning", ~brackets_balanced(text)),
        ("truncation", "marker", "error", is_truncated(text)),
        ("truncation", "ending", "warning", incomplete_ending(text, words)),
    ]
    found = F.array(*(F.when(F.coalesce(rule, F.lit(False)), _violation(c, n, s)) for c, n, s, rule in rules))
    return F.when(trimmed(text) == "", F.array(_violation("empty", "empty", "error"))).otherwise(F.filter(found, lambda v: v.isNotNull()))


def _violation(category: str, rule: str, severity: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def _of_severity(severity: str) -> Column:
    return F.size(F.filter("v", lambda x: x["severity"] == severity)).cast("long")


def completeness(df: DataFrame, item: str, text: str = "text") -> DataFrame:
    """(item, sentences, n_errors, n_warnings, complete, score): complete without errors; score as in check scores, 0.4 an error and 0.1 a warning."""
    t = F.col("_text")
    counted = df.select(item, F.col(text).alias("_text")).select(item, "_text", count_sentences(t).alias("sentences"), T.count_words(t).alias("_words"))
    v = counted.select(item, "sentences", violations(t, F.col("_words"), F.col("sentences")).alias("v"))
    n = {s: _of_severity(s) for s in ("error", "warning")}
    score = F.greatest(F.lit(0.0), 1 - 0.4 * n["error"] - 0.1 * n["warning"])
    return v.select(item, "sentences", n["error"].alias("n_errors"), n["warning"].alias("n_warnings"), (n["error"] == 0).cast("int").alias("complete"), F.round(score, 6).alias("score"))


def code_of(text: Column) -> Column:
    """What fenced blocks hold; without any, the text itself if it looks like code; else null."""
    blocks = F.regexp_extract_all(text, F.lit(P.CODE_BLOCK), F.lit(1))
    looks = text.rlike(P.CODE_BRACKETS) & says(text, P.CODE_WORDS)
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")).when(looks, text)


def code_unbalanced(text: Column) -> Column:
    """Some kind of bracket opens more or less often than it closes."""
    code = code_of(text)
    return F.coalesce(reduce(or_, (F.length(F.regexp_replace(code, a, "")) != F.length(F.regexp_replace(code, b, "")) for a, b in (("\\{", "\\}"), ("\\[", "\\]"), ("\\(", "\\)")))), F.lit(False))


def mid_sentence(text: Column) -> Column:
    last = last_line(text)
    return (F.length(last) > 15) & ~last.rlike("^[#>|`\\-*\\d\\[(]") & ~last.rlike("[.!?;:)\\]\"'`]\\z")


def abandonment(df: DataFrame, item: str, text: str = "text") -> DataFrame:
    """(item, kind, signal, severity): one row for each sign of an abandoned or stalled text. Texts of fewer than ten characters show none. Blocks written three times in a row are in repetition.tripled_block."""
    df = df.where(F.length(text) >= 10).select(item, right_trimmed(F.col(text)).alias("_text"))
    t = F.col("_text")
    rules = [("abandoned", label, "warning", says(t, p)) for label, p in P.ABANDONED.items()]
    rules += [
        ("abandoned", "mid sentence", "warning", mid_sentence(t)),
        ("abandoned", "unfinished marker", "warning", says(t, P.UNFINISHED)),
        ("abandoned", "unbalanced code", "error", code_unbalanced(t)),
        ("no_progress", "repeated errors", "warning", F.size(F.regexp_extract_all(t, F.lit(P.FAILURE), F.lit(0))) >= 3),
    ]
    found = F.array(*(F.when(rule, F.struct(F.lit(k).alias("kind"), F.lit(label).alias("signal"), F.lit(s).alias("severity"))) for k, label, s, rule in rules))
    return df.select(item, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r")).select(item, "r.*")


def formats(text: Column) -> dict[str, Column]:
    """What a text looks like, by format."""
    t = trimmed(text)
    rows = F.split(t, "\n")
    sep = F.when(rows[0].contains("\t"), "\t").otherwise(",")
    width = F.size(F.split(rows[0], sep))
    return {
        "json": json_valid(t),
        "markdown": says(t, "(?m)^#{1,6}\\s+") | says(t, "(?m)^[-*+]\\s|^\\d+\\.\\s|^```|^>"),
        "yaml": t.startswith("---") | says(t, "(?m)^[\\w-]+:\\s"),
        "xml": t.startswith("<?xml") | (t.startswith("<") & t.endswith(">")),
        "csv": (F.size(rows) >= 2) & F.forall(F.slice(rows, F.lit(2), F.size(rows)), lambda r: (trimmed(r) == "") | (F.size(F.split(r, sep)) == width)),
    }
