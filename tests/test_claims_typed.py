"""Typed claims on the kinds' own examples, overlaps, and the positional sweep against windows cut one by one."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import grounding as G


def claims(spark, text, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(G.typed_claims(F.col("t"), **options).alias("c")).first().c


@pytest.mark.parametrize(
    "text, kind, options",
    [
        ("The framework processes 10,000 requests per second. It achieves 99.9% uptime across all regions.", "statistic", {}),
        ("According to the official documentation, the API supports batch operations. The team reported that latency improved by 40%.", "attribution", {}),
        ("The project started in 2023 with a small team. Since 2024 it has grown significantly.", "temporal", {"kinds": ["temporal"]}),
        ("The documentation is available at https://docs.example.com/api for all users.", "reference", {"code": True}),
        ("Memory leaks cause the server to crash after 24 hours. This leads to data loss in production.", "causal", {}),
        ("The API provides automatic retry logic. There is a built-in rate limiter that supports configurable thresholds.", "existence", {}),
        ('He wrote "all of it works" on the board.', "quote", {}),
        ("The sky over the bay was grey that morning.", "factual", {}),
    ],
)
def test_kinds(spark, text, kind, options):
    got = claims(spark, text, **options)
    assert kind in [c.kind for c in got]
    assert all(text[c.start : c.end] == c.claim for c in got)
    assert all(a.end <= b.start for a, b in zip(got, got[1:]))


def test_what_is_no_claim(spark):
    assert claims(spark, "") == claims(spark, "   ") == claims(spark, None) == []
    assert claims(spark, "I think this is great. You should try it. Perhaps it works?") == []
    got = claims(spark, "I think this might work. Perhaps the issue is related. Please run 100 builds now. What takes 100 seconds here? The server processes 500 requests daily.")
    assert [c.claim for c in got] == ["What takes 100 seconds here", "The server processes 500 requests daily"]  # the sign of a question is not in the span


def test_overlaps_go_to_the_first_pattern(spark):
    text = "According to the report, the system processes 10,000 requests since 2023."
    assert [(c.kind, c.start, c.end) for c in claims(spark, text)] == [("statistic", 0, len(text) - 1)]
    assert [c.kind for c in claims(spark, text, least=0.9)] == ["attribution"]
    # the sentence goes, as it holds a claim found before; equal sentences are found at the first one's place
    assert [c.kind for c in claims(spark, "There is a cache layer in it. There is a cache layer in it.")] == ["existence"]
    assert len(claims(spark, " ".join(f"The server {i} handles {i}00 requests per second." for i in range(1, 21)), most=5)) == 5
    assert len(claims(spark, " ".join(f"The server {i} handles {i}00 requests per second." for i in range(1, 81)))) == 80


def test_code(spark):
    text = 'The API returns JSON always.\n```json\n{"count": 42, "more words": 43}\n```\nIt handles 100 requests.'
    assert not any("42" in c.claim for c in claims(spark, text)) and any("42" in c.claim for c in claims(spark, text, code=True))
    assert [c.kind for c in claims(spark, "The option `maxRetries: 3` is set by default", code=True, kinds=["reference"])] == ["reference"]


def test_numbers_with_points_and_edges(spark):
    got = claims(spark, "Version 3.25 took 99.5 seconds on é50 machines. Next sentence here follows")
    assert [(c.kind, c.claim) for c in got][0] == ("statistic", "5 seconds on é50 machines")  # a span ends at each point, and "25 took 99" is too short


def slow_best(claim, reference, window):
    words = re.split(r"[ \t\n\x0b\f\r]+", reference)
    content = lambda t: set(re.findall("[a-z0-9_]{3,}", t.lower()))
    n = max(len(re.split(r"[ \t\n\x0b\f\r]+", claim)) * 2, -(-window // 5))
    own, best = content(claim), (0.0, "")
    for i in range(0, max(0, len(words) - n) + 1, max(1, n // 3)):
        got = content(" ".join(words[i : i + n]))
        likeness = len(own & got) / len(own | got) if own and got else 0.0
        if likeness > best[0]:
            best = (likeness, " ".join(words[i : i + n]))
    return best


def test_sweep_equals_windows():
    rng = np.random.default_rng(4)
    for _ in range(120):
        words = [f"w{i:02d}" for i in range(int(rng.integers(3, 60)))] + ["a", "of", "x-ray-set", "A_B_c"]
        text = lambda n: " ".join(rng.choice(words, n)) + rng.choice(["", " ", "\n"])
        reference, window = text(int(rng.integers(0, 400))), int(rng.choice([5, 40, 500]))
        swept = G._Swept(reference)
        for _ in range(4):
            claim = text(int(rng.integers(1, 30)))
            assert swept.best(claim, window) == pytest.approx(slow_best(claim, reference, window)) or swept.best(claim, window)[1] == slow_best(claim, reference, window)[1]


def test_a_long_reference_and_many_claims():
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in rng.zipf(1.3, 20_000) % 5000]
    took = {}
    for n, k in ((5000, 250), (10_000, 500)):
        swept, start = G._Swept(" ".join(words[:n])), time.time()
        for i in range(k):
            swept.best(" ".join(words[i * 19 : i * 19 + 15]), 500)
        took[n] = time.time() - start
    assert took[10_000] < 3


def test_typed_verdicts(spark):
    ref = "The river flows past 40 mills between the old town and the sea every single day of the year"
    rows = [(1, "The river flows past 40 mills between the old town and the sea."), (2, "The river flows past 90 mills between the old town and the wide sea."), (3, "Because nothing here resembles it, we stop early."), (4, "This example shows 40 mills on the river."), (5, None)]
    df = spark.createDataFrame(rows, "i long, answer string").withColumn("reference", F.lit(ref))
    got = {r.i: (r.kind, r.status) for r in G.verified(df, "i", typed=True).collect()}
    assert got == {1: ("statistic", "grounded"), 2: ("statistic", "contradicted"), 3: ("causal", "ungrounded"), 4: ("statistic", "unverifiable")}


def test_batches_are_looked_through_in_pieces(spark, monkeypatch):
    """No more texts at once than PIECE, and the same claims in the same rows; so also for the likenesses of drift."""
    import pyarrow as pa

    from tracewell.functions import drift as D
    from tracewell.functions import grounding as G

    seen = []
    whole = G._extracted
    monkeypatch.setattr(G, "_extracted", lambda texts, *more: seen.append(len(texts)) or whole(texts, *more))
    taken = []
    monkeypatch.setattr(G.F, "arrow_udf", lambda run, kind: lambda text: taken.append(run))
    G.typed_claims(None)
    texts = pa.array([None if i % 7 == 0 else f"According to report {i}, the number of mills was {i + 100} in all." for i in range(2 * G.PIECE + 3)])
    assert taken[0](texts).equals(whole(texts, None, 0.5, False, float("inf"))) and seen == [G.PIECE, G.PIECE, 3]
    assert len(taken[0](texts.slice(0, 0))) == 0
    batch = pa.RecordBatch.from_pydict({"i": list(range(600)), "_left": [[["a", f"b{i}"]] for i in range(600)], "_right": [[["a"], []] for _ in range(600)]})
    out = list(D._likenesses(iter([batch])))
    assert max(b.num_rows for b in out) <= G.PIECE and [x for b in out for x in b.column("i").to_pylist()] == list(range(600))
