"""Each query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from cladeforge.plans import catalog

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([fix(r[i]) for i in order] for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
