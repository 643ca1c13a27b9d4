"""Every query with a twin in SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lumentide.plans import catalogue, extended, models, rasters  # noqa: F401  the others add to the catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def shown(v):
    if v is None or v != v:
        return "NULL"
    if hasattr(v, "year"):
        return str(v)[:10]
    return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(name, spark, con, sf_dir):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted(tuple(shown(r[c]) for c in sorted(got.columns)) for r in got.collect())
    b = sorted(tuple(shown(r[columns.index(c)]) for c in sorted(columns)) for r in want.fetchall())
    assert a == b
