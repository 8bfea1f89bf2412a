"""Columns with clashing or awkward names, repeated rows and very long texts in the stages of the pipeline, and the longest matches of op10."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, mixing, quality, simhash, substring_dedup

CLASHING = ["quality_score", "score", "contaminated", "n_words", "n_hit", "__text", "__quality_score", "__contaminated", "cut_spans", "a.b", "print", "component_id", "size", "taken", "row", "key", "words"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 400, n))
    rows = [(1, prose(120), "s"), (2, None, None), (3, "", "s"), (4, prose(80), "t"), (5, prose(80), "t"), (5, prose(60), "t"), (None, prose(50), None), (7, prose(200_000), "s")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))


def test_stages_keep_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, " ".join(odd.where("doc_id = 4").first().text.split()[10:40]))], "item_id long, text string")
    for most_words in (10_000, 10):
        clean = decontaminate.remove_contaminated(odd, benchmark, most_words)
        assert clean.columns == odd.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 1, 2, 3, 5, 5, 7]
    good = quality.kept_documents(odd, labels)
    assert good.columns == odd.columns and good.count() == odd.count()
    assert {r["a.b"] for r in good.collect()} == {CLASHING.index("a.b")}
    for stage in (simhash.keep_one_of_each, mixing.mixed_documents, substring_dedup.remove_repeats):
        out = stage(odd)
        assert out.columns == odd.columns and out.count() > 0, stage


def naive_longest(doc, items):
    """(words, start, item) of the longest run that doc shares with an item, of those that hold a window."""
    best = None
    for name, item in items:
        k = min(13, len(item))
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                if k and n >= k and (len(item) >= 13 or j == 0):
                    best = min(best or (-n, i, name), (-n, i, name))
    return (0, None, None) if best is None else (-best[0], *best[1:])


@pytest.mark.parametrize("most_words", [10_000, 40])
def test_longest_matches(spark, most_words):
    rng = np.random.default_rng(9)
    items = [(f"i{k}", [f"v{i}" for i in rng.integers(0, 6, n)]) for k, n in enumerate((40, 13, 5, 30, 30))] + [("copy", [])]
    items[5] = ("copy", items[0][1])
    docs = [[f"v{i}" for i in rng.integers(0, 6, n)] for n in (0, 30, 60)]
    docs += [docs[1] + items[0][1][5:33] + docs[2], items[3][1][:20] + items[4][1][2:22] + ["x"], items[2][1], ["q"] + items[1][1]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)] + [(99, " ".join(docs[3]))], "doc_id long, text string").repartition(2)
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id string, text string")
    got = {r.doc_id: (r.longest_words, r.longest_start, r.longest_item) for r in decontaminate.contamination(df, benchmark, most_words).collect()}
    assert got == {**{i: naive_longest(w, items) for i, w in enumerate(docs)}, 99: naive_longest(docs[3], items)}


def test_op10_sql(spark):
    import duckdb

    from tracewell.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        rel = con.execute(sql)
        names = [c[0] for c in rel.description]
        want = {tuple(sorted(zip(names, r))) for r in rel.fetchall()}
        assert {tuple(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, data).collect()} == want
