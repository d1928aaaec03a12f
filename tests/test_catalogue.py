"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from trilith.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(x, 6) if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [list(want.columns).index(c) for c in cols]
    assert plain(df.select(*(f"`{c}`" for c in cols)).collect()) == plain([tuple(r[i] for i in at) for r in want.fetchall()])
