"""Blocks written three times and repeated segments in long texts: against all blocks, and in time."""

import random
import time

from tracewell.functions import repetition as R


def test_tripled_against_all_blocks():
    rng, found = random.Random(3), 0
    for _ in range(1500):
        least = rng.choice([2, 3, 5])
        block = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        s = "".join(rng.choice("ab-") for _ in range(rng.randint(0, 30))) + block * rng.randint(1, 3) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        n = len(s)
        want = any(s[a : a + p] == s[a + p : a + 2 * p] == s[a + 2 * p : a + 3 * p] for p in range(least, n // 3 + 1) for a in range(n - 3 * p + 1))
        assert R.tripled(s, least) == want
        found += want
    assert found > 300


def log(n):
    """Lines between dashed rules, no block of which stands three times."""
    rng, parts, size = random.Random(4), [], 0
    while size < n:
        parts += [f"2026-01-01 INFO worker {rng.randint(0, 9)} step {rng.randint(0, 10**6)} took {rng.randint(0, 999)} ms", "-" * 80]
        size += len(parts[-2]) + 82
    return "\n".join(parts)


def test_long_logs():
    took = {}
    for n in (200_000, 1_000_000):
        text, start = log(n), time.time()
        assert not R.tripled(text)
        took[n] = time.time() - start
        assert R.tripled(text + "\n" + (text[1000:41_000] * 3) + "end")
    assert took[200_000] < 2 and took[1_000_000] < 8  # twice to eight times what an idle machine takes


def test_segments_that_share_their_longest_word():
    rng = random.Random(5)
    made = [f"commonlongestwordofall item {rng.randint(0, 10**6)} value {rng.randint(0, 10**6)} of {rng.randint(0, 10**6)} done {rng.randint(0, 10**6)}" for _ in range(20_000)]
    start = time.time()
    assert R.repeated(made + made[:10])["unique"] == 20_000
    assert time.time() - start < 6


def test_trigrams_are_not_shuffled(spark):
    """Rows dealt out are texts, one for each document; texts of one doc_id count together."""
    from tracewell import catalog

    rows = [(1, "a b c a b c a b c"), (1, "A, b; c"), (2, "x y"), (3, None), (4, "one two three")]
    df = catalog._ngram_saturation(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.score, r.unique_grams, r.total_grams) for r in df.collect()} == {1: (1.0, 3, 8), 4: (1.0, 1, 1)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
