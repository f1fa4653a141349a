"""Rounding as the SQL of a query rounds."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from gustframe.plans.registry import r6, rounded


def test_halves_like_sql(spark):
    x = F.col("id") / 2e6
    df = spark.range(-9_999_999, 10_000_000, 402).select("id", rounded(x).alias("a"), rounded(x, 4).alias("b"), r6(x).alias("plain"))
    theirs = {r[0]: r[1:] for r in duckdb.sql("select id, round(id / 2e6::double, 6), round(id / 2e6::double, 4) from range(-9999999, 10000000, 402) t(id)").fetchall()}
    got = df.collect()
    assert len(got) == len(theirs) > 40_000
    assert all((r["a"], r["b"]) == theirs[r["id"]] for r in got)
    assert any(r["plain"] != theirs[r["id"]][0] for r in got)


def test_none_and_nan(spark):
    df = spark.range(1).select(rounded(F.lit(None).cast("double")).alias("a"), F.isnan(rounded(F.lit(float("nan")))).alias("b"))
    assert tuple(df.first()) == (None, True)
