"""Rules on texts: required and forbidden keywords, phrases and patterns, as rows of violations with their place."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: required or forbidden; match: keyword (whole words), phrase or regex."""

    name: str
    kind: str
    match: str
    value: str
    severity: str = "error"
    case_sensitive: bool = False

    def pattern(self) -> str:
        body = self.value if self.match == "regex" else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", self.value)
        if self.match == "keyword":
            body = ("\\b" if re.match(r"\w", self.value) else "(?<!\\w)") + body + ("\\b" if re.search(r"\w\Z", self.value) else "(?!\\w)")
        return body if self.case_sensitive else f"(?i){body}"


def violations(df: DataFrame, item: str, rules: list[Rule], text: str = "text") -> DataFrame:
    """(item, rule, kind, severity, line, col): line from 1 and column from 0 of the first match of a forbidden rule, else null. A null text is an empty one.

    Rules are configuration, so they become expressions: one pass over the texts, no join.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.array(*(_violation(t, r) for r in rules)).cast("array<struct<rule:string,kind:string,severity:string,line:bigint,col:bigint>>")
    return df.select(item, F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select(item, "v.*")


def _violation(text: Column, rule: Rule) -> Column:
    there = text.rlike(rule.pattern())
    before = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(rule.pattern())) - 1)
    lines = F.split(before, "\n")
    forbidden = rule.kind == "forbidden"
    place = [F.size(lines), F.length(F.element_at(lines, -1))] if forbidden else [F.lit(None), F.lit(None)]
    row = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.severity).alias("severity"), *(p.cast("long").alias(n) for p, n in zip(place, ("line", "col"), strict=True)))
    return F.when(there if forbidden else ~there, row)


def satisfied(df: DataFrame, item: str, rules: list[Rule], text: str = "text") -> DataFrame:
    """(item, n_errors, n_warnings, status): one row for every text, also for those without violations."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = {s: sum((F.when(_violation(t, r).isNotNull(), 1).otherwise(0) for r in rules if r.severity == s), F.lit(0)).cast("long") for s in ("error", "warning")}
    return df.select(item, n["error"].alias("n_errors"), n["warning"].alias("n_warnings"), F.when(n["error"] > 0, "fail").otherwise("pass").alias("status"))
