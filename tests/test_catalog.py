"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest data."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def test_each_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, engine, name):
    df = catalog.queries()[name](spark, SF)
    got = engine.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [[plain(r[names.index(c)]) for c in df.columns] for r in got.fetchall()]
    assert sorted(map(str, want)) == sorted(str([plain(v) for v in r]) for r in df.collect())
