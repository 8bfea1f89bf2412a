"""The keyed store: what a write touches, dead writers, stale readers, replays, two writers at once."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tracewell.sources import annotations, commits, score_store

ROW = {"check": "a", "status": "pass", "startedAt": None, "startedAtMs": 1, "detail": None}


def rows(spark, *of):
    return spark.createDataFrame([(w, r, "a", float(s), "pass", None, 1, None) for w, r, s in of], score_store.SCORE)


def held(df):
    return sorted((r.worker, r.runId, r.score) for r in df.collect())


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_a_write_touches_its_workers_only(spark, root, tmp_path):
    at = score_store.store(spark, root)
    at.write(rows(spark, ("a", "1", 1), ("b", "1", 2)))
    before = at.state().folders
    stamps = {f: (tmp_path / "store" / f).stat().st_mtime_ns for f in before.values()}
    assert at.write(rows(spark, ("b", "1", 3), ("b", "2", 4))) == {"added": 1, "replaced": 1, "written": 2, "version": 2}
    after = at.state().folders
    changed = {d for d in before if before[d] != after[d]}
    assert len(changed) == 1 and all((tmp_path / "store" / f).stat().st_mtime_ns == t for f, t in stamps.items())
    assert held(at.read()) == [("a", "1", 1.0), ("b", "1", 3.0), ("b", "2", 4.0)]


def test_a_dead_writer_blocks_nothing(spark, root, tmp_path):
    at = score_store.store(spark, root)
    at.write(rows(spark, ("a", "1", 1)))
    dead = tmp_path / "store" / "data" / "dead" / "of=xyz"
    dead.mkdir(parents=True)
    (dead / "part-0.txt").write_text(json.dumps(ROW | {"worker": "a", "runId": "9", "score": 9.0}))
    (tmp_path / "store" / "log" / ".half").write_text('{"version": 2')
    assert held(at.read()) == [("a", "1", 1.0)]
    at.write(rows(spark, ("a", "1", 5)))
    assert held(at.read()) == [("a", "1", 5.0)]
    assert at.vacuum(hours=1) == []
    assert "dead" in at.vacuum(keep=1, hours=0) and held(at.read()) == [("a", "1", 5.0)] and not dead.exists()


def test_a_stale_reader_keeps_its_snapshot(spark, root):
    at = score_store.store(spark, root)
    at.write(rows(spark, ("a", "1", 1)))
    old = at.read()
    at.write(rows(spark, ("a", "1", 2), ("b", "1", 1)))
    assert held(old) == [("a", "1", 1.0)] and held(at.read(version=1)) == [("a", "1", 1.0)] and len(held(at.read())) == 2


def test_a_replayed_batch_changes_nothing(spark, root):
    at = score_store.store(spark, root)
    assert at.write(rows(spark, ("a", "1", 1)), "append", ("live", 0))["version"] == 1
    assert at.write(rows(spark, ("a", "1", 1)), "append", ("live", 0)) == {"added": 0, "replaced": 0, "written": 0, "version": 1}
    assert at.write(rows(spark, ("a", "1", 1)), "append", ("other", 0))["version"] == 2
    assert len(held(at.read())) == 2


@pytest.mark.parametrize("names", [("a", "b", "c"), ("a", "a", "a")])
def test_writers_at_once_lose_nothing(spark, root, names):
    score_store.store(spark, root).write(rows(spark, ("a", "0", 0)))
    ready, failed = threading.Barrier(3), []

    def write(i):
        try:
            at = score_store.store(spark, root)
            df = rows(spark, *((names[i], f"{i}-{k}", k) for k in range(5)))
            ready.wait()
            at.write(df)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    at = score_store.store(spark, root)
    assert not failed and held(at.read()) == sorted([("a", "0", 0.0), *((names[i], f"{i}-{k}", float(k)) for i in range(3) for k in range(5))])
    assert at.state().version == 4


def test_a_version_is_published_once(spark, root):
    files = commits.Files(spark, root)
    won = []
    threads = [threading.Thread(target=lambda i=i: files.publish("log/1.json", str(i)) and won.append(str(i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read("log/1.json") == won[0] and files.names("log") == [".1.json.crc", "1.json"] or files.names("log")[-1] == "1.json"


def test_log_with_whole_states_and_modes(spark, root, monkeypatch):
    monkeypatch.setattr(commits, "EVERY", 3)
    at = score_store.store(spark, root)
    for i in range(7):
        at.write(rows(spark, (f"w{i % 3}", str(i), i)), batch=("s", i))
    assert len(held(at.read())) == 7 and at.state().batches == {"s": 6} and at.state(3).version == 3
    at.write(rows(spark, ("w0", "x", 9)), "replace_partitions")
    assert {w for w, *_ in held(at.read())} == {"w0", "w1", "w2"} and sum(w == "w0" for w, *_ in held(at.read())) == 1
    at.write(rows(spark, ("w5", "y", 1)), "replace")
    assert held(at.read()) == [("w5", "y", 1.0)] and at.state().batches == {"s": 6}
    assert at.write(rows(spark))["written"] == 0 and at.state().version == 9


def test_files_of_others_until_a_worker_is_written(spark, root, tmp_path):
    for w in ("a", "b"):
        (tmp_path / "store" / w).mkdir(parents=True)
        (tmp_path / "store" / w / "scores.jsonl").write_text(json.dumps(ROW | {"worker": w, "runId": "1", "score": 0.5}))
    at = score_store.store(spark, root)
    assert at.write(rows(spark, ("a", "1", 1), ("a", "2", 1)))["replaced"] == 1
    assert held(at.read()) == [("a", "1", 1.0), ("a", "2", 1.0), ("b", "1", 0.5)]
    assert held(score_store.read_scores(spark, root, ["b"])) == [("b", "1", 0.5)]


def test_a_stream_into_the_store(spark, root, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = score_store.store(spark, root)

    def run():
        lines = spark.readStream.schema("value string").text(str(source))
        at.stream(score_store.parse_scores(lines), "live", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for k in range(2):
        (source / f"{k}.txt").write_text(json.dumps(ROW | {"worker": "a", "runId": str(k), "score": k}))
        run()
    version = at.state().version
    run()
    assert held(at.read()) == [("a", "0", 0.0), ("a", "1", 1.0)] and at.state().version == version == 2


def test_annotations_replace_their_judges_own(spark, root):
    verdicts = lambda v: spark.createDataFrame([("s1", v, "high", 0.9, None, None), ("s2", v, "low", 0.25, "why ", ["x", "y"])], "session_id string, verdict string, confidence_label string, confidence double, summary string, suggestions array<string>")
    at = annotations.store(spark, root)
    at.write(annotations.annotations_of(verdicts("fail"), "p", "t1"))
    at.write(annotations.annotations_of(verdicts("pass"), "p", "t2").where("session_id = 's2'"))
    at.write(annotations.annotations_of(verdicts("fail"), "q", "t3").where("session_id = 's2'"))
    note = spark.createDataFrame([("n1", "s3", "by hand", "me", "note", "t", "t")], annotations.ANNOTATION)
    at.write(note)
    got = {(r.session_id, r.author): r.text for r in at.read().collect()}
    assert got == {
        ("s1", "judge/p"): "[Tier-3 judge - opinion, not evidence] verdict=fail confidence=high (0.90)",
        ("s2", "judge/p"): "[Tier-3 judge - opinion, not evidence] verdict=pass confidence=low (0.25)\nwhy \nsuggestions: x; y",
        ("s2", "judge/q"): "[Tier-3 judge - opinion, not evidence] verdict=fail confidence=low (0.25)\nwhy \nsuggestions: x; y",
        ("s3", "me"): "by hand",
    }
    sessions = spark.createDataFrame([("s1", 1), ("s3", 2), ("s4", 3), ("s5", 4), ("s6", None)], "session_id string, started_at long")
    events = spark.createDataFrame([("s3",), ("s3",), ("s5",), ("s6",), ("s1",)], "session_id string")
    assert [r.session_id for r in annotations.unjudged(sessions, at.read(), events).collect()] == ["s5", "s3", "s6"]
    assert [r.session_id for r in annotations.unjudged(sessions, at.read(), events, 1).collect()] == ["s5"]
    assert at.read().where(F.col("author") == "judge/p").count() == 2
