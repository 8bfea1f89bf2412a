"""Two versions of a text: shared lines by longest common subsequence, changed lines, and copies of a source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tracewell.functions import patterns as P

#: Likeness from which an answer is a copy of its source, and the shortest source that containment makes one.
COPY, MIN_SOURCE = 0.8, 20


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with the table's rows as bits of whole numbers."""
    places: dict[str, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for line in b:
        hits = row & places.get(line, 0)
        row = (row + hits | row - hits) & full
    return len(a) - row.bit_count()


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def script(a: list[str], b: list[str]) -> list[dict]:
    """Lines kept, removed and added that turn a into b, in order, along a longest common subsequence: op, old and new line numbers (from 1) and the line. The rows of `common` are kept and read backwards."""
    places: dict[str, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for line in b:
        hits = rows[-1] & places.get(line, 0)
        rows.append((rows[-1] + hits | rows[-1] - hits) & full)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and (not j or rows[j] >> (i - 1) & 1):
            i -= 1
            out.append({"op": "remove", "old": i + 1, "new": None, "line": a[i]})
        elif not i or not rows[j - 1] >> (i - 1) & 1:
            j -= 1
            out.append({"op": "add", "old": None, "new": j + 1, "line": b[j]})
        else:
            i, j = i - 1, j - 1
            out.append({"op": "keep", "old": i + 1, "new": j + 1, "line": a[i]})
    return out[::-1]


@F.pandas_udf(ArrayType(StructType().add("op", StringType()).add("old", LongType()).add("new", LongType()).add("line", StringType())))
def _script(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([script(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def hunks(df: DataFrame, item: str, before: str, after: str, context: int = 3) -> DataFrame:
    """(item, hunk, kind, added, removed, first_line, last_line): changes with at most `context` kept lines between them. A hunk is cosmetic if its removed and added lines differ in white space only, reorder if only their order does, structural if one
    declares or imports something, else content."""
    every = df.select(item, F.posexplode(_script(all_lines(F.col(before)), all_lines(F.col(after)))).alias("at", "e")).select(item, "at", "e.*").where("op <> 'keep'")
    order = Window.partitionBy(item).orderBy("at")
    opens = F.coalesce((F.col("at") - F.lag("at").over(order) - 1 > context).cast("int"), F.lit(1))
    marked = every.withColumn("opens", opens).withColumn("hunk", F.sum("opens").over(order))
    line = F.coalesce("new", "old")
    grouped = marked.groupBy(item, "hunk").agg(_lines_of("add").alias("adds"), _lines_of("remove").alias("removes"), F.min_by(line, "at").alias("first_line"), F.max_by(line, "at").alias("last_line"))
    return grouped.select(item, "hunk", _kind().alias("kind"), F.size("adds").alias("added"), F.size("removes").alias("removed"), "first_line", "last_line")


def _lines_of(op: str) -> Column:
    """The lines of one op of a group (at, op, line), in order, with white space evened out."""
    return F.transform(F.filter(F.sort_array(F.collect_list(F.struct("at", "op", "line"))), lambda x: x["op"] == op), lambda x: F.regexp_replace(F.btrim(x["line"], F.lit(" \t\r")), "\\s+", " "))


def _kind() -> Column:
    """The kind of a change by its lines, adds and removes."""
    declares = F.exists(F.concat("adds", "removes"), lambda x: x.rlike(P.DECLARATION))
    return F.when(F.col("adds") == F.col("removes"), "cosmetic").when((F.size("adds") > 0) & (F.sort_array("adds") == F.sort_array("removes")), "reorder").when(declares, "structural").otherwise("content")


def all_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_diff(before: Column, after: Column) -> Column:
    """(common, added, removed, similarity) of lines; equal texts are alike by 1, and an empty text is like no other."""
    x, y = all_lines(before), all_lines(after)
    n = _common(x, y)
    empty = (F.coalesce(before, F.lit("")) == "") != (F.coalesce(after, F.lit("")) == "")
    alike = F.when(empty, 0.0).otherwise(F.round(n / F.greatest(F.size(x), F.size(y)), 6))
    return F.struct(n.alias("common"), (F.size(y) - n).alias("added"), (F.size(x) - n).alias("removed"), alike.alias("similarity"))


def cosmetic(before: Column, after: Column) -> Column:
    """The texts differ in white space and case only."""
    a, b = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    plain = [F.lower(F.regexp_replace(t, "\\s+", "")) for t in (a, b)]
    return (a != b) & (plain[0] == plain[1])


def parrots(answer: Column, source: Column) -> Column:
    """An answer holds its whole source of over 20 characters, or equals it, white space apart. On texts without line breaks, as these are after that, likeness of lines is equality."""
    a, s = (F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), "\\s+", " "), "^ | \\z", "") for t in (answer, source))
    return ((F.length(s) > MIN_SOURCE) & a.contains(s)) | (a == s)


def unified_changes(df: DataFrame, item: str, diff: str = "diff") -> DataFrame:
    """(item, file, hunks, added, removed) of the files of a unified diff. Lines before the first header of a file count for the file named ''; of a header pair the new name counts, or the old one where the file is gone."""
    lines = df.select(item, F.posexplode(F.split(F.coalesce(F.col(diff), F.lit("")), "\r?\n")).alias("pos", "line"))
    order = Window.partitionBy(item).orderBy("pos")
    # a header is a pair of lines, so that a removed line that begins with two hyphens is none
    old = F.col("line").startswith("--- ") & F.lead("line").over(order).startswith("+++ ")
    head = F.coalesce(old, F.lit(False))
    name = lambda c: F.regexp_replace(F.split(F.substring(c, F.lit(5), F.length(c)), "\t")[0], "^[ab]/", "")
    new = name(F.lead("line").over(order))
    named = F.when(head, F.when(new == "/dev/null", name(F.col("line"))).otherwise(new))
    marked = lines.withColumns({"head": head, "second": F.coalesce(F.lag(head).over(order), F.lit(False)), "named": named})
    marked = marked.withColumns({"part": F.count("named").over(order.rowsBetween(Window.unboundedPreceding, 0)), "file": F.coalesce(F.last("named", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(""))})
    body = marked.where("not head and not second")
    out = body.groupBy(item, "part", "file").agg(F.count_if(F.col("line").startswith("@@")).alias("hunks"), F.count_if(F.col("line").startswith("+")).alias("added"), F.count_if(F.col("line").startswith("-")).alias("removed"))
    return out.where("hunks + added + removed > 0").drop("part")


#: Fixed: the header of a hunk.
HUNK = r"^@@\s+-(\d+)(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@"


def unified_hunks(df: DataFrame, item: str, diff: str = "diff") -> DataFrame:
    """(item, change, kind, additions, deletions, start_line, end_line): the runs of changed lines of a unified diff, between context lines and headers, with the lines themselves and their place in the old text; kinds as of `hunks`. What stands before the first header of a hunk is none."""
    lines = df.select(item, F.posexplode(F.split(F.coalesce(F.col(diff), F.lit("")), "\n")).alias("at", "line"))
    before = Window.partitionBy(item).orderBy("at")
    head, context = F.col("line").rlike(HUNK), F.col("line").startswith(" ")
    changed = F.when(F.col("line").startswith("+") & ~F.col("line").startswith("+++"), "add").when(F.col("line").startswith("-") & ~F.col("line").startswith("---"), "remove")
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"op": F.when(~head, changed), "hunk": F.sum(head.cast("int")).over(upto), "change": F.sum((head | context).cast("int")).over(upto), "first": F.last(F.when(head, F.regexp_extract("line", HUNK, 1).cast("long")), ignorenulls=True).over(upto)})
    # old lines of the hunk up to here
    inside = Window.partitionBy(item, "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    old = F.sum((context | (F.col("op") == "remove")).cast("int")).over(inside)
    marked = marked.withColumn("until", F.col("first") + F.coalesce(old, F.lit(0))).where("hunk > 0 and op is not null")
    exact = lambda op: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("at", "op", "line"))), lambda x: x["op"] == op), lambda x: F.substring(x["line"], F.lit(2), F.length(x["line"])))
    plain = marked.withColumn("line", F.substring("line", F.lit(2), F.length("line")))
    kinds = plain.groupBy(item, "change").agg(_lines_of("add").alias("adds"), _lines_of("remove").alias("removes")).select(item, "change", _kind().alias("kind"))
    starts = F.min_by(F.col("until") - (F.col("op") == "remove").cast("int"), "at")
    whole = marked.groupBy(item, "change").agg(exact("add").alias("additions"), exact("remove").alias("deletions"), starts.alias("start_line"), F.max("until").alias("end_line"))
    return whole.join(kinds, [item, "change"]).select(item, "change", "kind", "additions", "deletions", "start_line", "end_line")


def meaningful_unified(df: DataFrame, item: str, diff: str = "diff", least: int = 1, substantive: bool = True) -> DataFrame:
    """(item, changes, n_substantive, meaningful): whether a unified diff has `least` changes at least, of which (substantive) those that are cosmetic or only reorder lines do not count."""
    counts = unified_hunks(df, item, diff).groupBy(item).agg(F.count("*").alias("changes"), F.count_if(~F.col("kind").isin("cosmetic", "reorder")).alias("n_substantive"))
    counted = df.select(item).join(counts, item, "left").fillna(0, ["changes", "n_substantive"])
    return counted.select(item, "changes", "n_substantive", ((F.col("changes") > 0) & (F.col("n_substantive" if substantive else "changes") >= least)).alias("meaningful"))
