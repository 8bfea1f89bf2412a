"""Every registered query against its DuckDB SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tracewell import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, str) else round(float(v), 6)

    return sorted((tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
