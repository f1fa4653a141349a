"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from gustframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.5f}"
    try:
        return f"{float(v):.5f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_like_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = _rows(df.columns, df.collect()), _rows(names, found.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(float(x) - float(y)) <= 2e-5 * max(1, abs(float(y)))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
