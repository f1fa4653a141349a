"""Queries against their SQL where a speed is 0: infinite, NaN and null are told apart."""

from __future__ import annotations

import math

import duckdb
import pytest

from gustframe.functions import wind
from gustframe.plans import catalogue

#: Heights of 5 + event_id % 130 m: below, at and above each level.
IDS = [0, 5, 6, 62, 75, 76, 115, 129, 135]


@pytest.fixture
def path(tmp_path):
    rows = ", ".join(f"({i + 1300 * k}, {v}::double)" for k, v in enumerate((0.0, 25.0, 560.21)) for i in IDS)
    duckdb.sql(f"copy (select event_id::bigint as event_id, timestamp '2024-01-01' as ts, 1::bigint as user_id, 'view' as event_type, value from (values {rows}) v(event_id, value)) to '{tmp_path}/events.parquet'")
    return str(tmp_path)


def _told(rows):
    return sorted([tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows], key=lambda r: r[0])


@pytest.mark.parametrize("name", ["q_alpha_shear", "q_layer_speed"])
def test_calm_like_sql(spark, path, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    mine, theirs = _told(catalogue.queries()[name](spark, path).collect()), _told(con.execute(catalogue.oracle_sql()[name]).fetchall())
    assert len(mine) == len(theirs) == 3 * len(IDS)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b or a == pytest.approx(b, rel=1e-9), (a, b)
    assert any("nan" in r or math.inf in r for r in mine)


def test_plans_keep_the_mask(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 4.0), (1.0, 0.0)], "a double, b double")
    got = [tuple(r) for r in df.select(wind.shear_levels("a", "b", 1, 2), wind.shear_levels("a", "b", 1, 2, missing=0.0), wind.shear_levels("a", "b", 1, 2, clamp=False, masked=False)).collect()]
    assert got == [(None, 0.0, math.inf), (pytest.approx(0.4), pytest.approx(0.4), pytest.approx(1.0)), (None, 0.0, -math.inf)]


def test_missing_speeds_like_sql(spark, tmp_path):
    values = ["null", "'nan'::double", "'inf'::double", "'-inf'::double", "-0.0::double", "1e-320::double", "-25.0::double", "-11.0::double", "-5.0::double", "25.0::double"]
    rows = ", ".join(f"({i}, {v})" for i, v in enumerate(values))
    duckdb.sql(f"copy (select event_id::bigint as event_id, timestamp '2024-01-01' as ts, 1::bigint as user_id, 'view' as event_type, value::double as value from (values {rows}) v(event_id, value)) to '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    mine, theirs = _told(catalogue.queries()["q_alpha_shear"](spark, str(tmp_path)).collect()), _told(con.execute(catalogue.oracle_sql()["q_alpha_shear"]).fetchall())
    assert len(mine) == len(values) and mine == theirs
    assert mine[0] == (0, 0.0, None)
