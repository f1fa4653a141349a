"""Operators against brute force, and plans against the shape they should have."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gustframe.functions import atmosphere as air
from gustframe.functions import solar, wind
from gustframe.functions.nulls import round_even
from gustframe.operators.asof import asof_backward, clip_to_range
from gustframe.operators.curves import cubic, dense_curves, interp
from gustframe.operators.geo import geodesic, haversine
from gustframe.operators.impute import impute, knn_fill
from gustframe.operators.relational import upsert, upsert_windowed
from gustframe.operators.sequences import ageing, ageing_from, drawn_age, dust, final_dust, real_age, running_seed
from gustframe.operators.reshape import plane_names
from gustframe.operators.stats import polyfit, quantiles
from gustframe.operators.timegrid import resample
from gustframe.plans.wind import from_reanalysis
from gustframe.streaming import recent

START = dt.datetime(2024, 1, 1, 0, 7)


def _series(spark, values, step=600, station="a"):
    rows = [(station, START + dt.timedelta(seconds=step * i), v) for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "station_id string, timestamp timestamp, v double")


def test_resample_counts_from_the_first_stamp_and_emits_empty_bins(spark):
    df = _series(spark, [1.0, 3.0, None, "gap", "gap", "gap"] + ["gap"] * 6 + [5.0])
    got = resample(df, "station_id", "timestamp", {"v": "mean"}).orderBy("timestamp").collect()
    assert [r["v"] for r in got] == [2.0, None, 5.0]
    assert [r["timestamp"] for r in got] == [START + dt.timedelta(hours=h) for h in range(3)]
    sums = resample(df, "station_id", "timestamp", {"v": "sum"}).orderBy("timestamp").collect()
    assert [r["v"] for r in sums] == [4.0, 0.0, 5.0]


def test_resample_of_an_empty_table(spark):
    assert resample(_series(spark, []), "station_id", "timestamp", {"v": "mean"}).count() == 0


def test_resample_has_one_exchange(spark):
    plan = resample(_series(spark, [1.0]), "station_id", "timestamp", {"v": "mean"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_asof_takes_the_last_row_at_or_before(spark):
    left = _series(spark, [0.0, 1.0, 2.0, 3.0]).withColumnRenamed("v", "x")
    right = _series(spark, ["gap", 10.0, None]).withColumnRenamed("v", "w")
    got = asof_backward(left, right, "station_id", "timestamp", ["w"]).orderBy("timestamp").collect()
    assert [r["w"] for r in got] == [None, 10.0, None, None]


def _knn_slowly(x, k):
    out, d = x.copy(), x.shape[1]
    for i in range(len(x)):
        for c in np.flatnonzero(np.isnan(x[i])):
            near = []
            for j in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if both.any() and not np.isnan(x[j, c]):
                    near.append((((x[i] - x[j])[both] ** 2).sum() * d / both.sum(), j))
            near = sorted(near)[:k]
            out[i, c] = np.mean([x[j, c] for _, j in near]) if near else np.nanmean(x[:, c])
    return out


def test_knn_like_brute_force():
    dice = np.random.default_rng(1)
    x = dice.normal(size=(80, 4))
    x[dice.random(x.shape) < 0.2] = np.nan
    assert np.allclose(knn_fill(x, 5), _knn_slowly(x, 5))


def test_impute_leaves_no_holes_and_columns_without_values(spark):
    df = _series(spark, [1.0, None, 3.0, 4.0, None, 6.0]).withColumn("u", F.lit(None).cast("double"))
    got = impute(df, "station_id", "timestamp", ["v", "u"]).orderBy("timestamp").collect()
    assert all(r["v"] is not None and r["u"] is None for r in got)


def _dust_slowly(rows, start=4.0):
    w, out = start, []
    for i, (r, m, d) in enumerate(rows):
        if i:
            w = w * (1 - 0.8 * m / 10) if r >= 1 else w + (d or 0.0)
        out.append(w)
    return out


@pytest.mark.parametrize("step", [600, 86_400 * 3])  # one chunk, and a few rows in each
def test_dust_like_a_loop(spark, step):
    dice = np.random.default_rng(2)
    rows = [(float(dice.integers(0, 3) * 0.6), float(dice.integers(0, 11)), None if i % 7 == 3 else float(dice.random())) for i in range(40)]
    df = spark.createDataFrame([(s, START + dt.timedelta(seconds=step * i), *r) for s in "ab" for i, r in enumerate(rows)] + [("c", START, 5.0, 10.0, 0.5)], "s string, t timestamp, r double, m double, d double")
    got = dust(df, ["s"], "t", "r", "m", "d", 4.0, 1.0, 0.8, 10).orderBy("s", "t").collect()
    assert [r["dust"] for r in got] == pytest.approx([*_dust_slowly(rows) * 2, 4.0])
    final = dict(map(tuple, final_dust(df, "s", "t", "r", "m", "d", 4.0, 1.0, 0.8, 10).collect()))
    assert final == pytest.approx({"a": _dust_slowly(rows)[-1], "b": _dust_slowly(rows)[-1], "c": 4.0})


@pytest.mark.parametrize("ranked", [20, 100_000])
def test_quantiles_like_numpy(spark, ranked):
    dice = np.random.default_rng(3)
    values = {"a": dice.normal(size=5000), "b": np.repeat([1.0, 2.0], 300), "c": np.array([7.0]), "d": np.round(dice.random(900), 1)}
    df = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own] + [("a", None)], "k string, v double")
    at = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r["k"]: (r["n"], r["q"]) for r in quantiles(df, ["k"], "v", at, ranked).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in values.items()}
    assert all(got[k][1] == pytest.approx(np.quantile(v, at).tolist()) for k, v in values.items())
    assert quantiles(df.limit(0), ["k"], "v", at).count() == 0


def test_drawn_ages_depend_on_seed_and_series_only(spark):
    df = spark.range(4000).selectExpr("cast(id as string) as s", "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 2 as int) * 400) as t")
    ages = {r["s"]: r["a"] for r in df.repartition(5).select("s", drawn_age("s", 42).alias("a")).collect()}
    assert ages == {r["s"]: r["a"] for r in df.select("s", drawn_age("s", 42).alias("a")).collect()}
    own = np.array(list(ages.values()))
    assert own.min() >= 0 and abs(own.mean() - 15) < 0.3 and abs(own.std() - 5) < 0.3
    real = spark.createDataFrame([(0, 3.0), (1, 8.0)], "idx long, age double")
    picked = {r["s"]: r["age"] for r in real_age(df, real, "s").collect()}
    assert set(picked.values()) == {3.0, 8.0} and len(picked) == 4000
    eta = [r["e"] for r in df.select(solar.drawn_efficiency(0.96, 42, "s").alias("e")).collect()]
    assert abs(np.mean(eta) - 0.96) < 1e-3 and abs(np.std(eta) - 0.01) < 1e-3
    assert df.select(solar.drawn_efficiency(0.96).alias("e")).distinct().count() == 1


def test_ageing_from_a_known_age(spark):
    df = _series(spark, [1.0] * 5, step=86400 * 100)
    got = ageing_from(df, "station_id", "timestamp", F.lit(10.0)).orderBy("timestamp").collect()
    since = (START - dt.timedelta(days=10 * 365.25)).date()
    days = (START + dt.timedelta(days=400) - dt.datetime.combine(since, dt.time())).days
    assert got[0]["commissioned"] == since
    assert [r["degradation"] for r in got] == pytest.approx(np.linspace(0.9937**10, 0.9937 ** (days / 365.25), 5).tolist())


def test_seeds_count_up_in_order(spark):
    keys = [f"k{i * 7919 % 5000:05d}" for i in range(3000)]
    got = {r["k"]: r["seed"] for r in running_seed(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 42).collect()}
    assert got == {k: 42 + i for i, k in enumerate(sorted(set(keys)))}


def test_a_spline_gives_back_a_cubic_and_ends_at_the_rating(spark):
    x = np.array([0.0, 2.0, 3.5, 6.0, 9.0, 13.0])
    at = np.linspace(0, 13, 200)
    assert np.allclose(cubic(x, x**3 - 4 * x**2 + x - 7, at), at**3 - 4 * at**2 + at - 7)
    rows = dense_curves(spark, {"t": ([1.0, 2.0, 4.0, 5.0], [0.0, 10.0, 90.0, 95.0])}, {"t": 100.0}).orderBy("ws_c").collect()
    assert [r["ws_c"] for r in rows] == list(range(501)) and rows[-1]["power_w"] == 100.0
    assert all(0 <= r["power_w"] <= 100 for r in rows) and rows[99]["power_w"] == 0.0 and rows[200]["power_w"] == pytest.approx(10.0)
    assert all(a["next_w"] == b["power_w"] for a, b in zip(rows, rows[1:], strict=False))


def test_noise_has_its_deviation_and_bounds(spark):
    df = spark.range(20000).select("id", wind.noisy(F.lit(100.0), F.lit(1000.0), 0.1, 42, "id").alias("p"), wind.noisy(F.lit(100.0), F.lit(105.0), 0.5, 42, "id").alias("q"))
    p, q = np.array([(r["p"], r["q"]) for r in df.collect()]).T
    assert abs(p.mean() - 100) < 0.5 and abs(p.std() - 10) < 0.5 and q.min() >= 0 and q.max() == 105


def test_geodesic_distances(spark):
    # Vincenty's own example, a quarter of the equator, one degree of a meridian, and nothing.
    rows = [(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777, 54.972271), (0.0, 0.0, 0.0, 90.0, 10018.754171), (0.0, 5.0, 1.0, 5.0, 110.574389), (10.0, 10.0, 10.0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, km double")
    for r in df.select("km", geodesic("a", "b", "c", "d").alias("got"), haversine("a", "b", "c", "d").alias("near")).collect():
        assert r["got"] == pytest.approx(r["km"], abs=1e-4) and r["near"] == pytest.approx(r["km"], rel=6e-3, abs=1e-6)


def test_clipping_in_the_pass_is_clipping_before(spark):
    left = _series(spark, [float(i) for i in range(20)]).withColumnRenamed("v", "x")
    right = _series(spark, ["gap"] * 3 + [10.0, None, "gap", 7.0]).withColumnRenamed("v", "w")
    want = asof_backward(clip_to_range(left, right, "station_id", "timestamp"), right, "station_id", "timestamp", ["w"])
    got = asof_backward(left, right, "station_id", "timestamp", ["w"], clip=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4


@pytest.mark.parametrize("name,most", [("q_wind_plan", 3), ("q_pv_plan", 2)])
def test_plans_deal_their_rows_out_seldom(spark, name, most):
    """One exchange before imputation, one before the hourly grid, one that brings the vertical wind in; none after."""
    from gustframe.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and ("station_id" in x or "__by" in x)]
    assert len(dealt) <= most + 1  # and one for the sums of the result
    assert plan.count("FileScan") == 2


def test_ageing_is_equally_spaced_by_row(spark):
    df = _series(spark, [1.0] * 5, step=86400 * 400)
    got = [r["degradation"] for r in ageing(df, "station_id", "timestamp", F.lit("2020-01-01").cast("timestamp")).orderBy("timestamp").collect()]
    first = 0.9937 ** ((START - dt.datetime(2020, 1, 1)).days / 365.25)
    last = 0.9937 ** ((START + dt.timedelta(days=1600) - dt.datetime(2020, 1, 1)).days / 365.25)
    assert got == pytest.approx(np.linspace(first, last, 5).tolist())


def test_rounding_is_half_even_after_scaling(spark):
    values = [1.005, 1.015, 2.5, 0.125, -0.125]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(round_even("v").alias("v")).collect()
    assert [r["v"] for r in got] == np.round(values, 2).tolist()


def test_sun_stands_high_at_noon_and_below_the_horizon_at_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 6, 21, 12),), (dt.datetime(2024, 6, 21, 0),)], "t timestamp")
    got = df.select("t", solar.position(F.col("t"), F.lit(52.5), F.lit(0.0)).alias("s")).orderBy("t").select("s.*").collect()
    assert got[0]["zenith"] > 90
    assert got[1]["zenith"] == pytest.approx(52.5 - 23.44, abs=0.3)
    assert math.isclose(got[1]["azimuth"], 180, abs_tol=2)


def test_upserts_agree(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"], update=True).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, upsert_windowed(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, upsert(old, new, ["k"], update=False).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_recent_stream_drops_repeats_and_upserts(spark, tmp_path):
    rows = [("a", START + dt.timedelta(minutes=10 * i), float(i)) for i in range(6)]
    late = [("a", START + dt.timedelta(days=9), 0.0)]
    spark.createDataFrame(rows + rows[:2] + late, "station_id string, timestamp timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = recent.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    hourly = recent.hourly(source, "station_id", "timestamp", ["v"])
    recent.upsert_to(hourly, str(tmp_path / "out"), ["station_id", "timestamp"], str(tmp_path / "cp")).awaitTermination()
    versions = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    got = spark.read.parquet(str(versions[-1])).orderBy("timestamp").collect()
    assert [(r["timestamp"].hour, r["v"]) for r in got] == [(0, 2.5)]


def test_polynomials_like_numpy(spark):
    dice = np.random.default_rng(5)
    x = dice.random(300) * 30
    y = 2 * x**3 - x**2 + 5 + dice.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    assert polyfit(df, "x", "y", 3) == pytest.approx(np.polyfit(x, y, 3).tolist(), rel=1e-4, abs=1e-3)


def test_reanalysis_in_this_librarys_units(spark):
    df = spark.createDataFrame([(3.0, 4.0, 6.0, 8.0, 293.15, 283.15, 101300.0)], "u_wind_10m double, v_wind_10m double, u_wind_100m double, v_wind_100m double, temp_2m double, dew_point_2m double, pressure double")
    r = from_reanalysis(df).first()
    assert (r["wind_speed"], r["wind_speed_100m"], r["pressure"]) == (5.0, 10.0, 1013.0)
    assert r["temperature_2m"] == pytest.approx(20.0) and 0.4 < r["relative_humidity"] * (1 if r["relative_humidity"] < 2 else 0.01) < 0.65


def test_interpolation_between_fixed_points(spark):
    points = [(0.0, 1.0), (2.0, 5.0), (3.0, 4.0)]
    xs = [-1.0, 0.0, 0.5, 2.0, 2.5, 9.0]
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(interp("x", points).alias("y")).collect()]
    assert got == pytest.approx(np.interp(xs, *zip(*points, strict=True)).tolist())


def test_planes_as_columns(spark):
    df = spark.createDataFrame([(1, 30.0, 180.0, 5.0), (1, 10.5, 90.0, 6.0), (2, 30.0, 180.0, 7.0)], "id int, tilt double, azimuth double, power double")
    wide = plane_names(df, ["id"], "power", [(30.0, 180.0), (10.5, 90.0)]).orderBy("id")
    rows = [tuple(r) for r in wide.collect()]
    assert rows == [(1, 5.0, 6.0), (2, 7.0, None)] and all("tilt" in c for c in wide.columns[1:])


def test_units_are_told_by_a_series_mean(spark):
    df = spark.createDataFrame([("k", 293.15, 1013.0), ("k", 283.15, 1012.0), ("c", 20.0, 101300.0), ("c", 10.0, 101200.0)], "s string, t double, p double")
    w = Window.partitionBy("s")
    got = sorted(tuple(r) for r in df.select("s", F.round(air.celsius("t", w), 6), air.pascal("p", w)).collect())
    assert got == [("c", 10.0, 101200.0), ("c", 20.0, 101300.0), ("k", 10.0, 101200.0), ("k", 20.0, 101300.0)]
