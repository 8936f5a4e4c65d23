"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from furrow.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_rows(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    assert got
    if name in catalogue.ORACLES:
        said = duck.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in said.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows_of(columns, said.fetchall())
