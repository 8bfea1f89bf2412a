"""Texts without any line that has something on it."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tracewell import text_queries

TEXTS = [None, "", " ", "\n\n", " \t\r\n" * 5, "\t" * 12, "\x0b", "word " * 60, "word " * 60 + "\n \n", "word " * 60 + "end.\n\n"]


@pytest.mark.parametrize("name", ["stub_truncation", "completeness", "abandonment"])
def test_no_lines(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": range(len(TEXTS)), "text": pa.array(TEXTS, pa.string())}), tmp_path / "documents.parquet")
    query, sql = text_queries.REGISTRY[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    plain = lambda rows: sorted(tuple(x if isinstance(x, str) else float(x) for x in row) for row in rows)
    assert plain(query(spark, str(tmp_path)).collect()) == plain(con.execute(sql).fetchall())
