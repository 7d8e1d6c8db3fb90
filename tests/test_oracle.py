"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(df):
    cols = sorted(df.columns)
    norm = lambda v: None if (isinstance(v, float) and math.isnan(v)) else (v.item() if hasattr(v, "item") else v)
    return cols, sorted((tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sp = entry.queries()[name](spark, SF).toPandas()
    dd = con.execute(entry.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dd)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 56
