"""Every registered series query runs; those with SQL give what DuckDB gives."""

import os

import duckdb
import pytest

from chronoloom.plans import catalogue

SF = "/root/testdata/sf0.001"
SLOW = {"fit_arma11", "param_summary_hessian"}


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in os.listdir(SF):
        found.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return found


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [q for q in catalogue.QUERIES if q not in SLOW])
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    assert rows
    if name in catalogue.ORACLES:
        cursor = con.execute(catalogue.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(got.columns)
        want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall()), key=repr)
        assert rows == want
