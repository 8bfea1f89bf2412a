import random

from pyspark.sql import functions as F

from tracewell.functions import diffs, markdown, references
from tracewell.operators import confidence, constraints, verification
from tracewell.operators.constraints import Rule


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert diffs.common(a, b) == plain_common(a, b)


def test_line_diff(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nc\nd"), (2, None, ""), (3, "x", None), (4, "A b", "a  B")], "i long, a string, b string")
    rows = {r.i: r for r in df.select("i", diffs.line_diff(F.col("a"), F.col("b")).alias("d"), diffs.cosmetic(F.col("a"), F.col("b")).alias("c")).select("i", "d.*", "c").collect()}
    assert (rows[1].common, rows[1].added, rows[1].removed, rows[1].similarity) == (2, 1, 1, 0.666667)
    assert rows[2].similarity == 1.0 and rows[3].similarity == 0.0 and rows[4].c


def test_parrots(spark):
    source = "please sort the list of names for me"
    df = spark.createDataFrame([(1, f"Sure:  {source}", source), (2, "sorted", source), (3, "same", "same"), (4, "it is short", "short"), (5, None, "x")], "i long, a string, s string")
    assert {r.i: r.p for r in df.select("i", diffs.parrots(F.col("a"), F.col("s")).alias("p")).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_markdown(spark):
    text = "# One\ntext\n```Python\n# not a heading\n```\n### Three ##\n## Two\n~~~\n# open"
    t = F.lit(text)
    row = spark.range(1).select(markdown.code_languages(t), markdown.heading_levels(t), markdown.heading_texts(t), markdown.level_skips(t), markdown.missing_sections(t, ["ONE", "Four"]), markdown.level_skips(F.lit(None).cast("string"))).first()
    assert list(row) == [["python", ""], [1, 3, 2], ["one", "three", "two"], 1, ["four"], 0]


def test_references(spark):
    df = spark.createDataFrame([(1, "See https://github.com/a/b.c, or https://x.org/y). Edit src/app.ts and ./run.sh and /etc/hosts; not etc."), (2, None)], "i long, text string")
    rows = {(r.kind, r.value) for r in references.references(df, "i").collect()}
    assert rows == {("url", "https://github.com/a/b.c"), ("url", "https://x.org/y"), ("repository", "a/b.c"), ("path", "src/app.ts"), ("path", "./run.sh"), ("path", "/etc/hosts")}
    known = spark.createDataFrame([("path", "/etc/hosts")], "kind string, value string")
    assert references.unknown(references.references(df, "i"), known).count() == 5


def test_constraints(spark):
    rules = [Rule("cpp", "required", "keyword", "C++"), Rule("bad", "forbidden", "phrase", "a.b", "warning"), Rule("digits", "forbidden", "regex", "\\d{3}")]
    df = spark.createDataFrame([(1, "C++ is fine"), (2, "xC++\nno a.b 123"), (3, None)], "i long, text string")
    rows = {(r.i, r.rule, r.line, r.col) for r in constraints.violations(df, "i", rules).collect()}
    assert rows == {(2, "cpp", None, None), (2, "bad", 2, 3), (2, "digits", 2, 7), (3, "cpp", None, None)}
    assert {r.i: (r.n_errors, r.n_warnings, r.status) for r in constraints.satisfied(df, "i", rules).collect()} == {1: (0, 0, "pass"), 2: (2, 1, "fail"), 3: (1, 0, "fail")}


def test_verification(spark):
    runs = spark.createDataFrame([("r1", "a", "pass", 10_000), ("r2", "a", "pass", 500_000), ("r3", "b", "fail", 1), ("r4", "c", "pass", 1), (None, None, None, None)], "run_id string, worker string, outcome string, reported_ms long")
    meta = spark.createDataFrame([("r1", None, "error", None, None), ("r1", "a", "ok", None, None), ("r2", "a", "running", None, 100_000), (None, "b", None, 0, None)], "run_id string, worker string, exit_status string, exit_code int, measured_ms long")
    rows = {r.run_id: (r.status, r.score) for r in verification.verification(runs, meta).collect()}
    assert rows == {"r1": ("fail", 0.4), "r2": ("warn", 0.6), "r3": ("warn", 0.8), "r4": ("skip", 0.0), None: ("skip", 0.0)}


def test_confidence(spark):
    why = "the answer names each file that it changed"
    rows = [("sure", 0.9, 1, 0.9, 2, why), ("sure", 0.95, 1, 0.9, 2, why), ("edge", 0.6, 1, 0.9, 2, why), ("edge", 0.62, 1, 0.9, 2, why), ("torn", 0.0, 1, 0.2, 0, "good"), ("torn", 1.0, 1, 0.2, 0, None)]
    df = spark.createDataFrame(rows, "item string, score double, weight int, confidence double, n_evidence int, reasoning string")
    out = {r["item"]: (r.recommendation, r.verdict) for r in confidence.assess(df, 2).collect()}
    assert out == {"sure": ("trust-verdict", "pass"), "edge": ("borderline", "needs-human-review"), "torn": ("contradictory", "needs-human-review")}
