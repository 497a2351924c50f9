"""Queries against their DuckDB SQL on the smallest tables, and all of them for a stable schema."""

import math
import os

import duckdb
import pytest

from strataframe.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def row(values):
    """What must be equal, then the floats, which must be close."""
    return tuple("" if isinstance(v, float) else str(v) for v in values), tuple(v + 0.0 for v in values if isinstance(v, float))


def assert_same_rows(got, expected):
    """Equal but for the last digits of floats: rows are paired by their other columns, then by the floats in order."""
    got, expected = (sorted(map(row, rows)) for rows in (got, expected))
    assert [k for k, _ in got] == [k for k, _ in expected]
    for (key, a), (_, b) in zip(got, expected, strict=True):
        assert len(a) == len(b), key
        assert all(x == y or math.isclose(x, y, rel_tol=1e-6, abs_tol=1.1e-6) or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True)), (key, a, b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in SQL:
        rel = con.sql(SQL[name])
        assert sorted(rel.columns) == cols
        assert_same_rows(got, rel.select(*[f'"{c}"' for c in cols]).fetchall())
    else:
        assert got
