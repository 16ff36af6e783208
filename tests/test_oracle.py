"""Every query against DuckDB on the smallest tables."""

import glob
import os
import threading

import duckdb
import pandas as pd
import pytest

from foliant.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql_or_is_a_kernel():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"filter_natural", "filter_enhanced", "filter_cleantext", "detect_corners", "warp_bilinear", "export_files", "export_record"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    """Values and types; the SQL under a limit on rows, which makes the engine plan some joins otherwise."""
    got = QUERIES[name](spark, sf_dir).toPandas()
    stop = threading.Timer(20, duck.interrupt)
    stop.start()
    want = duck.execute(f"SELECT * FROM ({SQL[name]}) LIMIT 10000000").df()
    stop.cancel()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=len(want) > 0, check_exact=True)
