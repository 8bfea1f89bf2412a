"""The guard by state with timers, and replayed over a finished table: both say what the other guard says."""

import os

import pytest

from tracewell.streaming.guard import GuardLimits, guard_with_timers, replay

SCHEMA = "session_id string, ts_ms long, type string, content string, tokens long"
BASE = 1_700_000_000_000


def streamed(spark, tmp_path, parts, limits):
    for i, part in enumerate(parts):
        spark.createDataFrame([(s, BASE + ts, *x) for s, ts, *x in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
        for f in (tmp_path / "in" / str(i)).iterdir():
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = guard_with_timers(stream, limits).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return sorted((r.session_id, r.reason, r.ts_ms - BASE, r.tokens) for r in spark.table("timed").collect())


@pytest.fixture
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def test_timers_and_replay_agree(spark, tmp_path, provider):
    rows = [("loop", i, "output", "same line", 1) for i in range(6)] + [("fine", i, "output", f"a line of number {i}", i) for i in range(6)] + [("turns", i, "output", ("first thing", "second thing")[i % 2], 1) for i in range(8)]
    rows += [("gap", 0, "output", "a", 1), ("gap", 150_000, "output", "b", 1), ("rich", 0, "output", "a", 10), ("rich", 1, "output", "b", 1000), ("rich", 2, "output", "c", 9999), *(("long", 90_000 * i, "output", f"words {i}", 1) for i in range(4)), ("long", 350_000, "end", None, 1), ("ended", 0, "output", "x", 1), ("ended", 5, "end", None, 2)]
    limits = GuardLimits(max_tokens=1000, max_ms=300_000, max_gap_ms=100_000, idle_ms=1_000_000, late_ms=1000)
    # the last batches only let event time pass: sessions without an end are let go by their timers
    parts = (rows[:3], rows[3:20], rows[20:], [("clock", 9_000_000, "output", "t", 1)], [("clock", 9_000_001, "end", None, 1)], [("clock", 9_000_002, "end", None, 1)])
    whole = spark.createDataFrame([(s, BASE + ts, *x) for p in parts for s, ts, *x in p], SCHEMA)
    said = sorted((r.session_id, r.reason, r.ts_ms - BASE, r.tokens) for r in replay(whole.repartition(5), limits).collect())
    assert {s: r for s, r, *_ in said} == {"loop": "loop", "turns": "loop", "gap": "stall", "rich": "tokens", "long": "timeout", "fine": "abandoned"}
    assert streamed(spark, tmp_path, parts, limits) == said


def test_replay_of_nothing(spark):
    assert replay(spark.createDataFrame([], SCHEMA)).count() == 0
