"""Functions called by name from spark.sql."""

import pytest

from tracewell.functions import assertions as A
from tracewell.functions import sql as S


def test_scalars(spark):
    S.register(spark)
    one = lambda q: spark.sql(f"SELECT {q} AS v").first().v
    assert one("tw_tokens('abcde')") == 2 and one("tw_tokens(NULL)") == 0 and one("tw_word_count(' a  b ')") == 2
    assert one("tw_slug('Hello, World!')") == "hello-world" and one("tw_jaccard('a B c', 'b C d')") == 0.5 and one("tw_jaccard('', NULL)") == 1.0
    assert one("tw_keyword_coverage('The cat', array('CAT', 'dog'))") == 0.5 and one("tw_keyword_coverage('x', array())") == 1.0
    assert [one(f"tw_duration({x})") for x in (0, 999, 1500, 90_000, 5_400_000)] == ["0ms", "999ms", "1.5s", "1.5m", "1.5h"]


def test_generators(spark):
    S.register(spark)
    spark.createDataFrame([(1, "# A\nThere are 100 lines in it.\n# B\nmore"), (2, None)], "id int, t string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("SELECT id, s.label, s.text FROM texts LATERAL VIEW explode(tw_segments(t)) v AS s").collect()] == [(1, "Introduction", "# A\nThere are 100 lines in it."), (1, "B", "more")]
    assert [tuple(r) for r in spark.sql("SELECT id, c.kind, c.claim FROM texts LATERAL VIEW explode(tw_claims(t)) v AS c").collect()] == [(1, "statistic", "There are 100 lines in it")]


def test_runs_of_a_session_stay_together(spark):
    rows = [(s, i, t, e) for s in "ab" for i, (t, e) in enumerate([("x", 1), ("x", 0), ("y", 0), ("x", 1), ("x", 1)])]
    df = spark.createDataFrame(rows, "session_id string, pos int, tool string, is_error int").repartition(7)
    got = sorted(tuple(r) for r in S.retry_runs(df).collect())
    assert got == sorted((s, *r) for s in "ab" for r in [("x", 0, 2, True, 1), ("y", 2, 1, False, 0), ("x", 3, 2, True, 2)])
    assert S.retry_runs(df.limit(0)).count() == 0


def test_custom_checks(spark):
    shouts = S.custom(spark, "shouts", lambda t: t.str.isupper())
    df = spark.createDataFrame([(1, "HELLO"), (2, "hello"), (3, None)], "id int, t string")
    assert [r.v for r in df.orderBy("id").select(shouts("t").alias("v")).collect()] == [True, False, False]
    df.createOrReplaceTempView("said")
    assert spark.sql("SELECT count(*) AS n FROM said WHERE shouts(t)").first().n == 1
    assert {(r.id, r.status) for r in A.assert_all(df, "id", {"shouts": shouts("t")}).collect()} == {(1, "pass"), (2, "fail"), (3, "fail")}
    bad = S.custom(spark, "bad", lambda t: t.map(lambda x: 1 / 0))
    with pytest.raises(Exception, match="division by zero"):
        df.select(bad("t")).collect()
