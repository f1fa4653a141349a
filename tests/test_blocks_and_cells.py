"""Imputation by blocks and nearest points by cells, against brute force."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustframe.operators.geo import nearest
from gustframe.operators.impute import impute, impute_in_blocks
from gustframe.plans import catalogue

START = dt.datetime(2024, 1, 1)


def _series(spark, n, seed, hot=0.9):
    dice = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v, u = dice.normal(), dice.normal() * 3 + 5
        rows.append(("a" if dice.random() < hot else "b", START + dt.timedelta(minutes=97 * i), None if dice.random() < 0.2 else float(v), None if dice.random() < 0.3 else float(u), i))
    return spark.createDataFrame(rows, "s string, t timestamp, v double, u double, i int")


def _slowly(rows, k=5):
    """One series' (t, v, u, i): i -> (v, u)."""
    rows = sorted(rows)
    day, year = [2 * math.pi * t.hour / 24 for t, *_ in rows], [2 * math.pi * t.month / 12 for t, *_ in rows]
    x = np.array([[math.nan if a is None else a, math.nan if b is None else b, math.sin(d), math.cos(d), math.sin(y), math.cos(y)] for (_, a, b, _), d, y in zip(rows, day, year, strict=True)])
    mean, dev = np.nanmean(x, 0), np.nanstd(x, 0)
    z = (x - mean) / np.where(dev < 1e-12, 1, dev)
    out = {}
    for n, r in enumerate(rows):
        own = []
        for c in (0, 1):
            near = sorted((round(float(np.nansum((z[n] - z[j]) ** 2)) * 6 / np.sum(~np.isnan(z[n] - z[j])), 9), j, z[j, c]) for j in range(len(rows)) if not np.isnan(z[j, c]))[:k]
            own.append(x[n, c] if not np.isnan(x[n, c]) else np.mean([v for *_, v in near]) * dev[c] + mean[c])
        out[r[3]] = tuple(0.0 if abs(v) < 0.01 else v for v in own)
    return out


@pytest.mark.parametrize("donors,holes", [(50, 16), (100_000, 100_000)])
def test_blocks_like_brute_force(spark, donors, holes):
    df = _series(spark, 700, 1)
    given = df.collect()
    slow = {i: v for s in "ab" for i, v in _slowly([(r["t"], r["v"], r["u"], r["i"]) for r in given if r["s"] == s]).items()}
    parts = {r["i"]: (r["v"], r["u"]) for r in impute_in_blocks(df, "s", "t", ["v", "u"], donors=donors, holes=holes).collect()}
    assert len(parts) == 700 and all(parts[i] == pytest.approx(slow[i]) for i in slow)


def test_blocks_like_whole_series(spark, donors=60, holes=20):
    # Without a value in common rows tie with all of their hour, which rounding decides in the whole series.
    df = _series(spark, 700, 1).filter("v is not null")
    whole = sorted(impute(df, "s", "t", ["v", "u"], scaled={"u": 10.0}).collect(), key=lambda r: r["i"])
    parts = sorted(impute_in_blocks(df, "s", "t", ["v", "u"], scaled={"u": 10.0}, donors=donors, holes=holes).collect(), key=lambda r: r["i"])
    assert parts[0].__fields__ == whole[0].__fields__
    assert [(r["v"], r["u"]) for r in parts] == [pytest.approx((r["v"], r["u"])) for r in whole]


def test_blocks_with_odd_series(spark):
    rows = [("a", START, None, 1.0, 0), ("a", START, float("nan"), 2.0, 1), (None, START, 3.0, None, 2), (None, START, None, None, 3), ("c", None, None, 4.0, 4), ("c", None, 5.0, None, 5)]
    df = spark.createDataFrame(rows, "s string, t timestamp, v double, u double, i int")
    got = {r["i"]: (r["v"], r["u"]) for r in impute_in_blocks(df, "s", "t", ["v", "u"]).collect()}
    assert got == {0: (None, 1.0), 1: (None, 2.0), 2: (3.0, None), 3: (3.0, None), 4: (5.0, 4.0), 5: (5.0, 4.0)}
    assert impute_in_blocks(df.limit(0), "s", "t", ["v", "u"]).count() == 0


def test_no_task_holds_a_hot_series(spark):
    plan = impute_in_blocks(_series(spark, 300, 2), "s", "t", ["v", "u"], donors=40, holes=20)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapGroupsInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")


def _km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def _places(dice, n, kind):
    if kind == "world":
        return [(float(np.degrees(np.arcsin(dice.uniform(-1, 1)))), float(dice.uniform(-180, 180))) for _ in range(n)]
    if kind == "poles":
        return [(float(dice.choice([-1, 1]) * dice.uniform(86, 90)), float(dice.uniform(-180, 360))) for _ in range(n)]
    if kind == "date line":
        return [(float(dice.uniform(-5, 5)), float((179 + dice.uniform(0, 2) + 180) % 360 - 180)) for _ in range(n)]
    return [(float(52 + dice.normal() * 0.001), float(13 + dice.normal() * 0.001)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["world", "poles", "date line", "town"])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_like_all_pairs(spark, kind, k):
    dice = np.random.default_rng(5)
    places = [*_places(dice, 40, kind), *_places(dice, 10, "world"), (90.0, 0.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0)]
    points = [*_places(dice, 60, kind), *_places(dice, 5, "town"), (90.0, 10.0), (0.0, 179.999)]
    points += points[:3]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(99, None, 1.0)], "id int, latitude double, longitude double")
    known = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(999, 1.0, None)], "point int, p_latitude double, p_longitude double")
    got = {}
    for r in nearest(df, known, "id", k).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["point"], r["distance"])
    assert set(got) == set(range(len(places)))
    for i, p in enumerate(places):
        slow = sorted((_km(*p, *q), j) for j, q in enumerate(points))
        assert [got[i][n + 1][1] for n in range(k)] == pytest.approx([x for x, _ in slow[:k]], abs=1e-6)
        for n in range(k):
            assert abs(_km(*p, *points[got[i][n + 1][0]]) - slow[n][0]) < 1e-6


def test_fewer_points_than_asked_for(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0), (2, -80.0, 100.0)], "id int, latitude double, longitude double")
    known = spark.createDataFrame([(7, 50.0, -60.0), (8, -50.0, 170.0)], "point int, p_latitude double, p_longitude double")
    assert nearest(df, known, "id", 5).count() == 4
    assert nearest(df, known.limit(0), "id", 2).count() == 0
    assert nearest(df.limit(0), known, "id", 2).count() == 0


@pytest.mark.parametrize("name", ["q_nearest", "q_knearest"])
def test_places_meet_points_by_equality(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
