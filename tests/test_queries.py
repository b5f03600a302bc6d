"""Each raster query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__
from lumisheet.queries import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours)
    key = [c for c in columns if ours[c].dtype.kind not in "f"]
    a, b = (x[columns].sort_values(key).reset_index(drop=True) for x in (ours, theirs))
    for c in columns:
        if c in key:
            assert (a[c] == b[c]).all()
        else:
            assert (a[c] - b[c]).abs().max() <= 1.01e-5


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["image_id", "y", "x", "l"]
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())
