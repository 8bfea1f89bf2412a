"""Fleet databases: SQLite files on a shared, mounted folder as a Spark data source (`fleet_database`), read by key ranges and written one file a task.

    spark.dataSource.register(FleetDatabase)
    spark.read.format("fleet_database").option("table", "sessions").schema("session_id string, started_at string").load(folder)

A path is a file or a folder of *.db files. Each file is cut into ranges of row ids, so partitions are disjoint and cover all rows; a task opens its file read-only and gets its range alone, through the table's own tree. Only the columns of the schema are selected (without one, all of them). Tests given as `where` are made by the database, so that a task gets only the rows
that pass. They are given by hand because Spark 4.1 keeps what it pushed into a Python source for one query and applies it to the next on the same DataFrame (test_filters_are_per_frame). Files must not change while they are read. Tables without row ids are read as one partition a file; a file without the table has no rows.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

#: Rows aimed at in a partition, and in an Arrow batch.
RANGE_ROWS, BATCH_ROWS = 250_000, 10_000


def local_path(path: str) -> str:
    parts = urllib.parse.urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: SQLite needs a mounted folder")
    return parts.path


def files_of(path: str) -> list[str]:
    at = local_path(path)
    return sorted(glob.glob(os.path.join(glob.escape(at), "*.db"))) if os.path.isdir(at) else [at]


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro&immutable=1", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str):
    """SQLite's own rule of affinity, by what the declared type contains."""
    kind = (declared or "").upper()
    if "INT" in kind:
        return LongType()
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if any(x in kind for x in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return BinaryType() if "BLOB" in kind else StringType()


#: What a value is cast to in SQLite, by the column's Spark type.
CASTS = {StringType: "TEXT", LongType: "INTEGER", IntegerType: "INTEGER", BooleanType: "INTEGER", DoubleType: "REAL", FloatType: "REAL", BinaryType: "BLOB"}
#: Tests that the database makes itself, on the values as they are stored.
TESTS = {"=": "{0} = ?", "<>": "{0} <> ?", ">": "{0} > ?", ">=": "{0} >= ?", "<": "{0} < ?", "<=": "{0} <= ?", "in": "{0} IN ({1})", "starts": "substr({0}, 1, ?) = ?", "null": "{0} IS NULL", "not null": "{0} IS NOT NULL"}


@dataclass
class RowRange(InputPartition):
    path: str
    #: The first row id and the one after the last; None for a whole table.
    first: int | None
    stop: int | None


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table, self.rows = schema, options["table"], int(options.get("rows", RANGE_ROWS))
        self.paths, self.where, self.values = files_of(options["path"]), [], []
        for column, test, value in json.loads(options.get("where", "[]")):
            self.where.append(TESTS[test].format(quoted(column), ", ".join("?" * len(value)) if test == "in" else ""))
            self.values += value if test == "in" else [len(value), value] if test == "starts" else [] if value is None else [value]
        for field in schema.fields:
            if type(field.dataType) not in CASTS:
                raise ValueError(f"{field.name}: a database has no {field.dataType.simpleString()}")

    def partitions(self) -> list[RowRange]:
        out = []
        for path in self.paths:
            with opened(path) as db:
                if not db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [self.table]).fetchone():
                    continue
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # WITHOUT ROWID
                    out.append(RowRange(path, None, None))
                    continue
            if low is not None:
                out += [RowRange(path, at, min(at + self.rows, high + 1)) for at in range(low, high + 1, self.rows)]
        return out or [RowRange("", 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        names = ", ".join(f"CAST({quoted(f.name)} AS {CASTS[type(f.dataType)]})" for f in self.schema.fields) or "1"
        where, values = list(self.where), list(self.values)
        if part.first is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [part.first, part.stop]
        kinds = [(f.name, {LongType: pa.int64(), IntegerType: pa.int32(), BooleanType: pa.bool_(), DoubleType: pa.float64(), FloatType: pa.float32(), BinaryType: pa.binary()}.get(type(f.dataType), pa.string())) for f in self.schema.fields]
        with opened(part.path) as db:
            cursor = db.execute(f"SELECT {names} FROM {quoted(self.table)}{' WHERE ' + ' AND '.join(where) if where else ''}", values)
            while rows := cursor.fetchmany(BATCH_ROWS):
                columns = [pa.array([None if v is None else bool(v) for v in c] if kind == pa.bool_() else list(c), kind) for c, (_, kind) in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in kinds])


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceArrowWriter):
    """Each task fills a file under a name of its own; it gets its .db name when all have ended, so that what a lost task leaves is never read."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table, self.folder = schema, options["table"], local_path(options["path"])
        declared = {StringType: "TEXT", LongType: "INTEGER", IntegerType: "INTEGER", BooleanType: "INTEGER", DoubleType: "REAL", FloatType: "REAL", BinaryType: "BLOB"}
        self.columns = ", ".join(f"{quoted(f.name)} {declared[type(f.dataType)]}" for f in schema.fields)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f".{uuid.uuid4().hex}.part")
        db = sqlite3.connect(path)
        try:
            db.execute(f"CREATE TABLE {quoted(self.table)} ({self.columns})")
            for batch in batches:
                db.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * batch.num_columns)})", zip(*(c.to_pylist() for c in batch.columns)))
            db.commit()
        finally:
            db.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        for i, m in enumerate(m for m in messages if m):
            os.rename(m.path, os.path.join(self.folder, f"{self.table}-{i:05d}-{uuid.uuid4().hex}.db"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class FleetDatabase(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fleet_database"

    def schema(self) -> StructType:
        for path in files_of(self.options["path"]):
            with opened(path) as db:
                found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
            if found:
                return StructType([StructField(name, spark_type(kind)) for _, name, kind, *_ in found])
        raise ValueError(f"{self.options['path']} has no table {self.options['table']}")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, columns: str | None = None, where: list[tuple] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """A table of the databases under a path: the columns of a DDL, or all; rows that pass all tests of `where`, (column, one of TESTS, value), value a list for `in` and None for the null tests."""
    spark.dataSource.register(FleetDatabase)
    source = spark.read.format("fleet_database").option("table", table).option("rows", rows).option("where", json.dumps(list(where)))
    return (source.schema(columns) if columns else source).load(path)


def write_table(df: DataFrame, path: str, table: str) -> None:
    df.sparkSession.dataSource.register(FleetDatabase)
    df.write.format("fleet_database").option("table", table).mode("append").save(path)
