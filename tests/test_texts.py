"""Text functions against plain versions and on cases planted by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions import actionability as act
from tracewell.functions import completeness as C
from tracewell.functions import grounding as G
from tracewell.functions import repetition as R


def ask(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r[0] for r in df.select("i", column(F.col("text")).alias("v")).orderBy("i").select("v").collect()]


def test_tripled_against_regex():
    rng = random.Random(5)
    texts = ["", "a" * 149, "a" * 150, "x" * 30 + ("ab c" * 15) * 3 + "tail", "x" + ("abc" * 17) * 2]
    for _ in range(60):
        block = "".join(rng.choice("ab\n") for _ in range(rng.randint(45, 70)))
        texts.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + block * rng.randint(1, 4) + block[: rng.randint(0, 20)])
    assert [R.tripled(t) for t in texts] == [re.search(r"(?s)(.{50,})\1{2,}", t) is not None for t in texts]


def test_repeated_segments():
    a, b = "the same sentence comes again and again.", "an entirely different line of some length."
    assert R.repeated([a, b]) == {"score": 0.0, "ratio": 0.0, "unique": 2, "total": 2}
    assert R.repeated([]) == {"score": 0.0, "ratio": 0.0, "unique": 0, "total": 0}
    out = R.repeated([a, a.upper(), a])
    assert (out["unique"], out["total"]) == (1, 3) and out["score"] == round(0.6 * 2 / 3 + 0.4 * 2 / 3, 6)


def test_cycles():
    assert R.cycles(["read file", "write file"] * 3) == {"loops": 1, "longest": 3, "ratio": 1.0}
    assert R.cycles(["one line", "two lines", "three lines"])["loops"] == 0
    assert R.cycles([]) == {"loops": 0, "longest": 0, "ratio": 0.0}


def test_brackets(spark):
    texts = ["f(a[0]) {}", "f(a[0)]", 'a "(" b', "it's (open", "(", "", None, 'x \\" (y)']
    assert ask(spark, texts, C.brackets_balanced) == [True, False, True, True, False, True, True, True]


def test_stubs_and_truncation(spark):
    texts = ["TODO: write the whole thing later on", "yes", "short", None, "This answer has all that was asked for in it.", "I'm sorry, but that is beyond me today."]
    assert ask(spark, texts, C.is_stub) == [True, False, True, True, False, True]
    assert ask(spark, ["it goes on...", "done.", "- one\n-", "[truncated] text", None], C.is_truncated) == [True, False, True, True, False]


def test_sentences(spark):
    assert ask(spark, ["Dr. Who paid 3.50 today. Really? Yes!", "no end", "", None, "wait... what"], C.count_sentences) == [3, 1, 0, 0, 1]


def test_completeness(spark):
    df = spark.createDataFrame([(1, ""), (2, "A plain answer that says what is needed."), (3, None)], "i long, text string")
    rows = {r.i: r for r in C.completeness(df, "i").collect()}
    assert (rows[1].complete, rows[2].complete, rows[3].complete) == (0, 1, 0)
    assert rows[2].score == 1.0 and rows[1].n_errors == 1


@pytest.mark.parametrize(("word", "stemmed"), [("studies", "study"), ("running", "run"), ("nation", "nate"), ("class", "class"), ("cats", "cat"), ("stopped", "stop"), ("dies", "die"), ("cat", "cat"), ("quickly", "quick"), ("sing", "sing")])
def test_stem(spark, word, stemmed):
    assert ask(spark, [word], G.stem) == [stemmed]


def test_relevance(spark):
    df = spark.createDataFrame([(1, "copy the parser files", "copy the parser files"), (2, "parser", "weather"), (3, "", None), (4, "parse trees", "parse forests")], "i long, task string, answer string")
    out = {r.i: r.relevance for r in G.relevance(df, "i").collect()}
    assert out[1] == pytest.approx(1.0) and out[2] == out[3] == 0.0 and 0 < out[4] < 1


def test_grounding(spark):
    ref = "The river flows past 40 mills between the old town and the sea every single day of the year"
    df = spark.createDataFrame(
        [(1, "The river flows past 40 mills between the old town and the sea every day of the year."), (2, "The river flows past 90 mills between the old town and the wide sea."), (3, "Nothing here resembles what anybody wrote before."), (4, "This example shows the river and the mills."), (5, None)],
        "i long, answer string",
    ).withColumn("reference", F.lit(ref))
    status = {r.i: r.status for r in G.verified(df, "i").collect()}
    assert status == {1: "grounded", 2: "contradicted", 3: "ungrounded", 4: "unverifiable"}
    scores = {r.i: r.score for r in G.hallucination(G.verified(df, "i"), "i").collect()}
    assert scores == {1: 0.0, 2: 1.0, 3: 0.8, 4: 0.0}
    assert G.verified(df.limit(0), "i").count() == 0


def test_actionability(spark):
    df = spark.createDataFrame(
        [(1, "How to install it?", "Run `npm install` first.\nSet timeout = 30 in src/app."), (2, "Explain it", "It depends on your situation. There are many ways to do it."), (3, "Explain it", None)],
        "i long, task string, answer string",
    )
    rows = {r.i: r for r in act.actionability(df, "i").collect()}
    assert rows[1].response_type == "how-to" and rows[1].passed == 1 and rows[1].actionable_ratio == 1.0
    assert rows[2].passed == 0 and rows[2].filler_ratio == 1.0
    assert rows[3].sentences == 0 and rows[3].score == 0.0


def test_actionability_as_its_sql(spark, tmp_path):
    """Word boundaries and white space as RE2 has them, and halves rounded as SQL does it."""
    import duckdb

    from tracewell import text_queries

    answers = ["Setü the thing today.", "Set it. réadd it now.", "Run\x0bit. Check\u2028 the port = 8ä and 9ms.", "\x0bInstall it.\rOpen it.", "Füllt add. Addé it. Read\u0085 on.", *("Run it. " * k + "Say no more of it. " * (16 - k) for k in range(1, 16)), None]
    rows = [(i, turn, role, text) for i, a in enumerate(answers) for turn, role, text in ((0, "user", "how tö fix it"), (1, "assistant", a))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    query, sql = text_queries.REGISTRY["actionability"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = con.execute(sql).df().sort_values("conv_id")
    ours = query(spark, str(tmp_path)).toPandas().sort_values("conv_id")[list(theirs.columns)]
    assert ours.values.tolist() == theirs.values.tolist()


def test_formats_as_their_sql(spark, tmp_path):
    """A text that only begins with a JSON value is none; what json_valid allows beyond the standard is allowed."""
    import duckdb

    from tracewell import text_queries

    texts = ['4703443633947811 Achverber', "12", "[1] [2]", "1, 2", '{"a": 1} x', "[1,]", '{"a": 1,}', "[,]", "{,}", '{"a": 1, "a": 2}', "NaN", "-inf", "[nan]", "01", "1.", "-0", "1e999", '"\\ud800"', '"\\ud83d\\ude00"', '"\\udc00"', '"a\tb"', "'a'", "nullx", "true", "tru",
             "[" * 1500 + "]" * 1500, "[1}", "{1: 2}", '{"a" 1}', '{"a": }', '{"a":', "[1 2]", "]", '"', '""', "1 ,", "\x0b1", "[1\x0c]", "/* */ 1", "é: 1", "a:\x0b1", "#\x0bhead", "x\r# head", "x\u2028- item", "a,b\n\x0b\n1,2", "a\tb\n1\t2", "", None, "  [1, {}] \n", "[" + "7" * 3000 + "]"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = text_queries.REGISTRY["format_sniff"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(sql).df().sort_values("doc_id")
    ours = query(spark, str(tmp_path)).toPandas().sort_values("doc_id")[list(theirs.columns)]
    assert ours.values.tolist() == theirs.values.tolist()
