"""Every query with oracle SQL against DuckDB on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, sf, name):
    got = entry.queries()[name](spark, sf)
    want = tables.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    rows = sorted([shown(r[i]) for i in order] for r in want.fetchall())
    assert sorted([shown(r[c]) for c in sorted(names)] for r in got.collect()) == rows
