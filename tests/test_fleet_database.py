"""The fleet database source: partitions, projection, pushed filters, odd tables, and what a writer leaves."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracewell.sources import fleet_database as fd


@pytest.fixture
def folder(tmp_path):
    for k in range(3):
        db = sqlite3.connect(tmp_path / f"{k}.db")
        db.execute("CREATE TABLE sessions (session_id TEXT PRIMARY KEY, started_at TEXT, n INTEGER, cost REAL, raw BLOB, note, ok BOOLEAN)")
        db.executemany("INSERT INTO sessions VALUES (?, ?, ?, ?, ?, ?, ?)", [(f"s{k}-{i}", None if i % 7 == 0 else f"2026-01-{i % 28 + 1:02d}", i if i % 5 else None, i / 4, bytes([i % 256]), "x" if i % 2 else 5, i % 2) for i in range(200)])
        db.execute("DELETE FROM sessions WHERE n BETWEEN 40 AND 90")
        db.execute("CREATE TABLE pairs (a TEXT, b INTEGER, PRIMARY KEY (a)) WITHOUT ROWID")
        db.execute("INSERT INTO pairs VALUES ('k', ?)", [k])
        db.commit()
        db.close()
    sqlite3.connect(tmp_path / "other.db").execute("CREATE TABLE elsewhere (x)")
    return str(tmp_path)


def every(folder, sql):
    out = []
    for k in range(3):
        out += sqlite3.connect(f"{folder}/{k}.db").execute(sql).fetchall()
    return sorted(map(repr, out))


def test_partitions_are_disjoint_and_cover(spark, folder):
    df = fd.read_table(spark, folder, "sessions", rows=33)
    assert df.schema.simpleString() == "struct<session_id:string,started_at:string,n:bigint,cost:double,raw:binary,note:string,ok:string>"
    got = df.withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in got}) >= 15 and len({r.session_id for r in got}) == len(got)
    assert sorted(repr((r.session_id, r.n, r.cost)) for r in got) == every(folder, "SELECT session_id, n, cost FROM sessions")
    reader = fd.Reader(df.schema, {"path": folder, "table": "sessions", "rows": "33"})
    ranges = {}
    for p in reader.partitions():
        ranges.setdefault(p.path, []).append((p.first, p.stop))
    assert len(ranges) == 3 and all(b == c for r in ranges.values() for (_, b), (c, _) in zip(r, r[1:]))


def test_only_asked_columns_and_types(spark, folder):
    df = fd.read_table(spark, folder, "sessions", "ok boolean, n int, note string, cost float")
    assert sorted(repr((r.ok, r.n, r.note)) for r in df.collect()) == sorted(repr((bool(i % 2), i if i % 5 else None, "x" if i % 2 else "5")) for _ in range(3) for i in range(200) if not (i % 5 and 40 <= i <= 90))
    assert df.count() == len(df.collect())
    assert fd.read_table(spark, folder, "pairs", rows=1).groupBy("a").agg(F.sum("b")).collect()[0][1] == 3
    with pytest.raises(Exception, match="has no"):
        fd.read_table(spark, folder, "sessions", "n array<int>").collect()
    with pytest.raises(Exception, match="no table"):
        fd.read_table(spark, folder, "missing")


def test_filters_reach_the_database(spark, folder):
    cases = {
        "n > 150": [("n", ">", 150)], "n >= 10 AND n < 20 AND cost <= 4.0": [("n", ">=", 10), ("n", "<", 20), ("cost", "<=", 4.0)], "session_id IN ('s1-5', 's2-7', 'zz')": [("session_id", "in", ["s1-5", "s2-7", "zz"])],
        "n IS NULL": [("n", "null", None)], "started_at IS NOT NULL AND n = 33": [("started_at", "not null", None), ("n", "=", 33)], "session_id LIKE 's1-1%'": [("session_id", "starts", "s1-1")], "n <> 7": [("n", "<>", 7)],
    }
    for sql, tests in cases.items():
        df = fd.read_table(spark, folder, "sessions", "session_id string, n long", tests, rows=50)
        assert sorted(repr((r.session_id, r.n)) for r in df.collect()) == every(folder, f"SELECT session_id, n FROM sessions WHERE {sql}"), sql
    with pytest.raises(Exception, match="like"):
        fd.read_table(spark, folder, "sessions", None, [("n", "like", 3)]).collect()


def test_filters_are_per_frame(spark, folder):
    df = fd.read_table(spark, folder, "sessions")
    for where in ("n > 150", "session_id LIKE 's1-1%'", "n <> 7 OR cost > 3", "n = 3"):
        assert sorted(repr((r.session_id, r.n)) for r in df.where(where).collect()) == every(folder, f"SELECT session_id, n FROM sessions WHERE {where}"), where


def test_written_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/out folder"
    df = spark.range(1000).select("id", F.concat(F.lit("it's "), "id").alias("te\"xt"), (F.col("id") / 3).alias("x"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2 == 0).alias("even"))
    fd.write_table(df.repartition(4), path, "things")
    names = os.listdir(tmp_path / "out folder")
    assert len(names) == 4 and all(n.endswith(".db") for n in names)
    back = fd.read_table(spark, path, "things", "id long, `te\"xt` string, x double, even boolean")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    (tmp_path / "out folder" / ".lost.part").write_text("half a file")
    assert back.count() == 1000
    fd.write_table(df.limit(0), path, "things")
    assert back.count() == 1000


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "bad")
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="stop"):
        fd.write_table(bad.repartition(3), path, "things")
    assert not [n for n in os.listdir(path) if n.endswith(".db")] if os.path.isdir(path) else True


def test_no_files(spark, tmp_path):
    assert fd.read_table(spark, str(tmp_path), "sessions", "session_id string").count() == 0
    with pytest.raises(Exception, match="mounted"):
        fd.read_table(spark, "s3a://bucket/x", "sessions", "session_id string").count()
