"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def tidy(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return v

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = tidy([tuple(r[c] for c in columns) for r in df.collect()])
    at = [rel.columns.index(c) for c in columns]
    want = tidy([tuple(r[i] for i in at) for r in rel.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
