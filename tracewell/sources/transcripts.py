"""Markdown transcripts: files <worker>/YYYY-MM-DD-HHmm.md into sections, by a running sum of headings over the lines of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The sections of a transcript and whether it must have them.
SECTIONS = {"task": True, "actions taken": True, "key outputs": True, "outcome": True, "errors & retries": False, "duration": True}


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(worker, run_id, date, text) of the files below path; other files are left out."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("*", F.col("_metadata.file_path").alias("file"))
    pattern = "([^/]+)/((\\d{4}-\\d{2}-\\d{2})-\\d{4})\\.md$"
    part = lambda i: F.regexp_extract("file", pattern, i)
    return files.where(F.col("file").rlike(pattern)).select(part(1).alias("worker"), part(2).alias("run_id"), F.to_date(part(3)).alias("date"), F.col("value").alias("text"))


def sections(transcripts: DataFrame) -> DataFrame:
    """(worker, run_id, slug, pos, body): second-level sections; of sections with one name the first counts."""
    lines = transcripts.select("worker", "run_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("pos", "line"))
    by_run = Window.partitionBy("worker", "run_id").orderBy("pos")
    heading = F.regexp_extract("line", "^##[ \t]+(.*?)[ \t]*$", 1)
    df = lines.withColumn("slug", F.when(F.col("line").rlike("^##[ \t]"), F.lower(heading))).withColumn("part", F.count("slug").over(by_run))
    bodies = df.where("part > 0").groupBy("worker", "run_id", "part").agg(F.max("slug").alias("slug"), F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.when(F.col("slug").isNull(), F.struct("pos", "line")))).alias("lines"))
    text = F.btrim(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(" \t\n"))
    first = Window.partitionBy("worker", "run_id", "slug").orderBy("pos")
    return bodies.select("worker", "run_id", "slug", "pos", text.alias("body")).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def missing_sections(transcripts: DataFrame) -> DataFrame:
    """(worker, run_id, slug): required sections that a transcript lacks or leaves empty."""
    wanted = F.explode(F.array(*(F.lit(s) for s, required in SECTIONS.items() if required)))
    have = sections(transcripts).where("body <> ''").select("worker", "run_id", "slug")
    return transcripts.select("worker", "run_id", wanted.alias("slug")).join(have, ["worker", "run_id", "slug"], "left_anti")


#: First words of an outcome, and what an errors section says when there were none.
OUTCOMES = {
    "pass": ["pass", "passed", "success", "succeeded", "ok", "completed", "done"],
    "fail": ["fail", "failed", "failure", "error", "errored", "crashed"],
    "partial": ["partial", "incomplete", "mixed", "partially"],
}
NO_ERRORS = "^(no errors?|none|n a|no failures?|no retries|no retry|no issues|nothing)\\b"
ITEM = "^\\s*(?:\\d+[.)]|[-*+])\\s+(.*)$"


def title(text: Column) -> Column:
    """The first-level heading before any other text; empty without one."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.rtrim(x)), lambda x: (F.trim(x) != "") & ~x.rlike("^#{2,}"))
    first = F.get(lines, F.lit(0))
    return F.coalesce(F.when(first.startswith("# "), F.trim(F.substring(first, 3, 1_000_000))), F.lit(""))


def list_items(body: Column) -> Column:
    """Items of a list, with the lines that go on below each joined by a space; a blank line ends an item."""
    lines = F.split(F.coalesce(body, F.lit("")), "\r?\n")
    # each line marked: an item begins (1), text goes on (2), blank (3); text goes to the last item unless a blank line lies between
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        item, rest = F.regexp_extract(line, ITEM, 1), F.trim(line)
        last = F.try_element_at(acc["done"], F.lit(-1))
        longer = F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), F.array(F.concat(last, F.lit(" "), rest)))
        done = F.when(line.rlike(ITEM), F.concat(acc["done"], F.array(item))).when(acc["open"] & (rest != "") & (F.size(acc["done"]) > 0), longer).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(line.rlike(ITEM), True).when(rest == "", False).otherwise(acc["open"]).alias("open"))

    return F.filter(F.transform(F.aggregate(lines, start, step)["done"], F.trim), lambda x: x != "")


def outcome(body: Column) -> Column:
    """pass, fail, partial or unknown, by the first word of the first line that is not blank."""
    first = F.get(F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\r?\n"), F.trim), lambda x: x != ""), F.lit(0))
    word = F.regexp_extract(F.lower(first), "^[^a-z]*([a-z]+)", 1)
    found = F.lit("unknown")
    for name, words in OUTCOMES.items():
        found = F.when(word.isin(*words), name).otherwise(found)
    return F.coalesce(found, F.lit("unknown"))


def had_errors(body: Column) -> Column:
    """An errors section says something of two words or more that is no denial."""
    norm = F.trim(F.lower(F.regexp_replace(F.coalesce(body, F.lit("")), "[\\s\\W]+", " ")))
    return (norm != "") & ~norm.rlike(NO_ERRORS) & norm.contains(" ")


def duration_ms(body: Column) -> Column:
    """Milliseconds between the first and the last of two clock times or more (over midnight, if the last is earlier), else the sum of hours, minutes and seconds, else the first number as minutes; null without any."""
    text, low = F.trim(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    clock = F.regexp_extract_all(text, F.lit("\\b(\\d{1,2}:\\d{2})\\b"), F.lit(1))
    minutes = lambda t: F.split(t, ":")[0].cast("long") * 60 + F.split(t, ":")[1].cast("long")
    a, b = F.get(clock, F.lit(0)), F.try_element_at(clock, F.lit(-1))
    real = lambda t: (F.split(t, ":")[0].cast("int") < 24) & (F.split(t, ":")[1].cast("int") < 60)
    between = F.pmod(minutes(b) - minutes(a), F.lit(1440))
    by_clock = F.when((F.size(clock) >= 2) & real(a) & real(b) & (between > 0), (between * 60_000).cast("double"))
    add = lambda unit, ms: F.aggregate(F.regexp_extract_all(low, F.lit(f"(\\d+(?:\\.\\d+)?)\\s*(?:{unit})\\b"), F.lit(1)), F.lit(0.0), lambda acc, x: acc + x.cast("double") * ms)
    units = add("h|hr|hrs|hour|hours", 3_600_000) + add("m|min|mins|minute|minutes", 60_000) + add("s|sec|secs|second|seconds", 1000)
    number = F.regexp_extract(text, "(\\d+(?:\\.\\d+)?)", 1)
    return F.coalesce(by_clock, F.when(units > 0, units), F.when(number != "", number.cast("double") * 60_000))


def facts(transcripts: DataFrame) -> DataFrame:
    """(worker, run_id, date, title, actions, outcome, had_errors, duration_ms, n_missing) of each transcript: what its scores and trends are made of."""
    body = lambda slug: F.max(F.when(F.col("slug") == slug, F.col("body")))
    wanted = [s for s, required in SECTIONS.items() if required]
    by_run = sections(transcripts).groupBy("worker", "run_id").agg(
        F.size(list_items(body("actions taken"))).alias("actions"), outcome(body("outcome")).alias("outcome"), had_errors(body("errors & retries")).alias("had_errors"), duration_ms(body("duration")).alias("duration_ms"),
        F.count_if(F.col("slug").isin(*wanted) & (F.col("body") != "")).alias("n_have"),
    )
    df = transcripts.select("worker", "run_id", "date", title(F.col("text")).alias("title")).join(by_run, ["worker", "run_id"], "left")
    df = df.fillna({"actions": 0, "outcome": "unknown", "had_errors": False, "n_have": 0})
    return df.withColumn("n_missing", F.lit(len(wanted)) - F.col("n_have")).drop("n_have")


def started_ms(run_id: Column, zone: str = "-07:00") -> Column:
    """The time in a run's name (YYYY-MM-DD-HHmm), read in a zone; one with summer time, such as America/Los_Angeles, has the offset of its date."""
    local = F.to_timestamp_ntz(run_id, F.lit("yyyy-MM-dd-HHmm"))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), utc) / 1000).cast("long")


#: Fixed: characters of an event's text.
EVENT_TEXT = 280


def timeline(transcripts: DataFrame, zone: str = "-07:00") -> DataFrame:
    """Run events (session_id, worker, model, pos, ts_ms, type, tokens, tool, tool_sig, text) of transcripts, for sessions, issues and check scores: a start, the actions taken spread evenly over the run, an error if there were some and the run did not pass, and an end with a known outcome."""
    body = lambda slug: F.max(F.when(F.col("slug") == slug, F.col("body")))
    parts = sections(transcripts).groupBy("worker", "run_id").agg(list_items(body("actions taken")).alias("items"), body("errors & retries").alias("errors"))
    df = facts(transcripts).join(parts, ["worker", "run_id"], "left").withColumns({"items": F.coalesce("items", F.array().cast("array<string>")), "start": started_ms(F.col("run_id"), zone)})
    end = F.col("start") + F.coalesce(F.col("duration_ms").cast("long"), F.lit(0).cast("long"))
    span, n = F.coalesce(F.col("duration_ms"), F.lit(0.0)), F.size("items")
    cut = lambda x: F.when(F.length(x) > EVENT_TEXT, F.concat(F.substring(x, 1, EVENT_TEXT - 1), F.lit("…"))).otherwise(x)
    event = lambda ts, kind, text: F.struct(ts.cast("long").alias("ts_ms"), F.lit(kind).alias("type"), text.alias("text"))
    actions = F.transform("items", lambda x, i: event(F.col("start") + F.round(span * (i + 1) / (n + 1)), "output", cut(x)))
    first = F.array(event(F.col("start"), "start", F.coalesce(F.nullif("title", F.lit("")), F.concat("worker", F.lit(" run")))))
    failed = F.when(F.col("had_errors") & (F.col("outcome") != "pass"), event(end - 1, "error", cut(F.col("errors"))))
    last = F.when(F.col("outcome") != "unknown", event(end, "end", F.col("outcome")))
    rows = df.where("start is not null").select(F.concat_ws("/", "worker", "run_id").alias("session_id"), "worker", F.posexplode(F.concat(first, actions, F.array_compact(F.array(failed, last)))).alias("i", "e"))
    none = F.lit(None).cast("string")
    return rows.select("session_id", "worker", none.alias("model"), (F.col("i") + 1).cast("long").alias("pos"), "e.ts_ms", "e.type", F.lit(0).cast("long").alias("tokens"), none.alias("tool"), none.alias("tool_sig"), "e.text")
