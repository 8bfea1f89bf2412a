"""How far can a reader act on an answer? Sentences become rows; a sentence's score is an expression over pattern counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions.completeness import any_of, says, trimmed

BLOCK = "```[\\s\\S]*?```"
SENTENCE = "[^.!?\\n]+(?:[.!?](?:\\s|\\z)|\\n|\\z)"
WORD = "[A-Za-z0-9_]{4,}"


def response_type(task: Column) -> Column:
    low, out = F.lower(task), F.lit("general")
    for name, needed in reversed(P.RESPONSE_TYPE):
        out = F.when(reduce(and_, (says(low, p) for p in needed)), name).otherwise(out)
    return out


def answer_sentences(text: Column) -> Column:
    """Fenced blocks, each as one, and the sentences of what lies between them."""
    between = F.flatten(F.transform(F.split(text, BLOCK), lambda s: F.regexp_extract_all(s, F.lit(P.java(SENTENCE)), F.lit(0))))
    blocks = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))
    return F.filter(F.transform(F.concat(between, blocks), trimmed), lambda s: s != "")


def _count(s: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(P.java(pattern)), F.lit(0)))


def _rounded(x: Column) -> Column:
    """To six places as SQL does it: the millionfold, halves up. F.round looks at the decimal digits that are shown, which differ at halves."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def _is(rule: Column) -> Column:
    return rule.cast("int")


def elements(s: Column) -> dict[str, Column]:
    """Concrete content of a sentence: how often each kind occurs."""
    return {
        "imperative": _is(says(s, P.IMPERATIVE)),
        "code-snippet": _count(s, P.CODE),
        "file-reference": _count(s, P.FILE),
        "command": _count(s, P.COMMAND),
        "url-reference": _count(s, P.URL),
        "step": _is(says(s, P.STEP)),
        "specific-value": _count(s, P.VALUE),
        "decision-point": _is(says(s, P.DECISION)),
        "example": _is(says(s, P.EXAMPLE) & (F.length(s) > 30)),
    }


def filler(s: Column, task: Column) -> dict[str, Column]:
    """Filler of a sentence: how many patterns of each kind occur."""
    words = F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0))
    asked = F.regexp_extract_all(F.lower(task), F.lit(WORD), F.lit(0))
    shared = F.size(F.filter(words, lambda w: F.array_contains(asked, w)))
    plain = ~any_of(s, [P.CODE, P.FILE, P.URL, P.VALUE])
    return {
        "hedge": sum((_is(says(s, p)) for p in P.HEDGE), F.lit(0)),
        "platitude": sum((_is(says(s, p)) for p in P.PLATITUDE), F.lit(0)),
        "weasel-word": sum((_is(says(s, p)) for p in P.WEASEL), F.lit(0)),
        "restatement": _is((F.length(task) > 10) & (F.size(words) > 4) & (shared > 0.6 * F.size(words))),
        "generic-advice": _is((F.length(s) < 80) & plain & says(s, P.GENERIC)),
        "circular": _is(says(s, P.CIRCULAR)),
        "non-answer": _is(says(s, P.NON_ANSWER) & ~any_of(s, P.COMMITTED)),
    }


def actionability(df: DataFrame, item: str, task: str = "task", answer: str = "answer") -> DataFrame:
    """(item, response_type, sentences, score, actionable_ratio, filler_ratio, specificity, passed). Answers without a sentence score 0.

    Rows that are partitioned by `item` stay where they are: a text's sentences are aggregated without another shuffle.
    """
    rows = df.select(item, F.coalesce(F.col(task), F.lit("")).alias("_task"), F.coalesce(F.col(answer), F.lit("")).alias("_answer"))
    s = rows.withColumn("_type", response_type(F.col("_task"))).select(item, "_task", "_type", F.explode_outer(answer_sentences(F.col("_answer"))).alias("_s"))
    e, f = elements(F.col("_s")), filler(F.col("_s"), F.col("_task"))
    s = s.select(item, "_type", "_s", *(c.alias(f"e_{k}") for k, c in e.items()), *(c.alias(f"f_{k}") for k, c in f.items()))
    e, f = {k: F.col(f"`e_{k}`") for k in e}, {k: F.col(f"`f_{k}`") for k in f}
    n = sum(e.values(), F.lit(0))
    best = F.greatest(*(F.when(c > 0, P.SPECIFICITY[k]).otherwise(0.0) for k, c in e.items()))
    weight = [_by_type(i) for i in range(3)]
    kinds = [("imperative", "command", "step"), ("file-reference", "specific-value", "code-snippet"), ("example", "code-snippet")]
    by_type = sum((F.when(sum((e[k] for k in group), F.lit(0)) > 0, w).otherwise(0.0) for group, w in zip(kinds, weight, strict=True)), F.lit(0.0))
    gain = F.when(n > 0, 0.4 * (best + F.least(F.lit(0.2), (n - 1) * 0.05)) + 0.6 * by_type).otherwise(0.0)
    penalty = F.least(F.lit(0.8), sum((c * P.PENALTY[k] for k, c in f.items()), F.lit(0.0)))
    # rounded before the comparison with 0.3, so that sums in another order agree
    s = s.select(item, "_type", "_s", n.alias("n"), sum((c * round(100 * P.SPECIFICITY[k]) for k, c in e.items()), F.lit(0)).alias("spec"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), gain - penalty)), 6).alias("score"), sum(f.values(), F.lit(0)).alias("n_filler"))
    acts = F.col("score") >= 0.3
    out = s.groupBy(item).agg(
        F.first("_type").alias("response_type"),
        F.count("_s").alias("sentences"),
        F.coalesce(F.avg(F.when(F.col("_s").isNotNull(), F.col("score"))), F.lit(0.0)).alias("mean"),
        F.coalesce(F.avg(F.when(F.col("_s").isNotNull(), _is(acts))), F.lit(0.0)).alias("acts"),
        F.coalesce(F.avg(F.when(F.col("_s").isNotNull(), _is(~acts & (F.col("n_filler") > 0)))), F.lit(0.0)).alias("fills"),
        F.coalesce(F.sum("spec") / 100 / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("spec"),
    )
    score = F.when(F.col("sentences") > 0, 0.4 * F.col("mean") + 0.3 * F.col("acts") + 0.2 * F.col("spec") + 0.1 * (1 - F.col("fills"))).otherwise(0.0)
    out = out.withColumn("score", _rounded(score))
    return out.select(item, "response_type", "sentences", "score", _rounded(F.col("acts")).alias("actionable_ratio"), _rounded(F.col("fills")).alias("filler_ratio"), _rounded(F.col("spec")).alias("specificity"), _is((F.col("score") >= 0.4) & (_rounded(F.col("acts")) >= 0.3)).alias("passed"))


def _by_type(i: int) -> Column:
    out = F.lit(P.RESPONSE_WEIGHTS["general"][i])
    for name, weights in P.RESPONSE_WEIGHTS.items():
        out = F.when(F.col("_type") == name, weights[i]).otherwise(out)
    return out
