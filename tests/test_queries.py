"""Every query with an oracle, against DuckDB on the smallest tables."""

import glob
import os

import pytest

from tidelog.plans import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def _plain(v):
    return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.oracles():
        assert rows
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    found = con.execute(catalog.oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
