"""Every catalog query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyglass.plans import audit, catalog, limits

assert audit and limits  # they add their queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    places = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in places]) for r in want.fetchall())


@pytest.mark.parametrize("name", ["isotonic_curve", "logit_frequency", "anova_interaction", "nfkc_match", "greedy_match"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).columns
