"""Every query with SQL gives the same rows in DuckDB, on the smallest supplied tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    return str([norm(y) for y in x]) if isinstance(x, list | tuple) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
    assert any(x is not None for r in rows for x in r)
