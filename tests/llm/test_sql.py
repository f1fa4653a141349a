"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from gustframe.llm import queries
from tests.llm.helpers import SF


@pytest.mark.parametrize("name", ["op11_resample", "op12_ngram_join", "op13_merkle"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, df.select(*names).collect())) == sorted(repr(r) for r in df.sparkSession.createDataFrame(found.fetchall(), df.select(*names).schema).collect())
