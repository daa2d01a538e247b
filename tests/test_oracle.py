"""Every registered query that has SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from replen.detail_queries import ORACLE, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float) and not math.isfinite(v):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return round(float(v), 4) + 0.0


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    if name not in ORACLE:
        assert found
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.columns, found), rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    off = [(g, w) for g, w in zip(got, want) if any(a != b and not (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-4 + 1e-6 * abs(b)) for a, b in zip(g, w))]
    assert not off, off[:3]
