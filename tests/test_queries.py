"""Every query with a DuckDB counterpart against it, and the contract of the entry module."""

from __future__ import annotations

import math

import pytest

import __spark_entry__
from veilframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    df, rel = catalogue.queries()[name](spark, sf), duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", catalogue._NOT_SQL)
def test_rows_only(spark, sf, name):
    rows = catalogue.queries()[name](spark, sf).collect()
    assert rows


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
