"""Ranking of candidates with claims: weights renormalised, ties, winners."""

import pytest

from tracewell.operators import traces

COLUMNS = "model string, tool_calls long, error_rate double, recovery_rate double, longest_streak long, tokens long, contradicted long, unverifiable long, integrity double"


def ranked(spark, rows, **options):
    return {r.model: r for r in traces.rank_selection(spark.createDataFrame(rows, COLUMNS), **options).collect()}


def test_contradictions_and_missing_integrity(spark):
    same = (10, 0.0, 1.0, 0, 100)
    got = ranked(spark, [("honest", *same, 0, 0, 1.0), ("lies", *same, 1, 0, 0.5), ("silent", *same, 0, 3, None), ("lies", *same, 0, 0, None)])
    # of all sub-scores 1 but steps and cost, which are 0 for equals of the most
    assert got["honest"].score == pytest.approx(7 / 8.5, abs=5e-4) and got["silent"].score == pytest.approx(5 / 6.5, abs=5e-4)
    assert got["lies"].score == pytest.approx((1.0 + 3) / 8.5, abs=5e-4) and got["lies"].clean_run == 0
    assert [got[m].rank for m in ("honest", "silent", "lies")] == [1, 2, 3] and got["silent"].integrity is None


def test_weights(spark):
    rows = [("a", 10, 0.5, 1.0, 0, 100, 0, 0, 1.0), ("b", 20, 0.0, 1.0, 0, 200, 2, 0, 0.0)]
    assert ranked(spark, rows)["a"].rank == 1
    only = {k: 0 for k in traces.CLAIM_WEIGHTS} | {"error_rate": 1}
    assert [ranked(spark, rows, weights=only)[m].score for m in "ab"] == [0.5, 1.0]
    assert ranked(spark, rows, weights={k: 0 for k in traces.CLAIM_WEIGHTS})["b"].score == 0.0
    assert traces.sane_weights({"steps": -1, "cost": float("nan"), "recovery": True, "thrash": "2", "integrity": 0, "other": 5}) == traces.CLAIM_WEIGHTS | {"integrity": 0.0}


def test_ties_and_winner(spark):
    row = (10, 0.0, 1.0, 0, 100, 0, 0, None)
    ranking = traces.rank_selection(spark.createDataFrame([("b", *row), ("a", *row), ("c", 20, *row[1:])], COLUMNS))
    assert {r.model: r.rank for r in ranking.collect()} == {"a": 1, "b": 1, "c": 3}
    summary = traces.ranking_summary(ranking).first()
    assert summary.winner is None and summary.chain == "a = b > c"
    alone = traces.ranking_summary(traces.rank_selection(spark.createDataFrame([("x", *row)], COLUMNS))).first()
    assert (alone.winner, alone.chain) == ("x", "x")
    # equal scores: fewer contradictions first
    got = ranked(spark, [("p", 10, 0.0, 1.0, 0, 100, 2, 0, None), ("q", 10, 0.0, 1.0, 0, 100, 1, 0, None)])
    assert got["p"].score == got["q"].score and (got["q"].rank, got["p"].rank) == (1, 2)
