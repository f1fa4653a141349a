"""The sun's place against a published worked example and against the coarser series."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gustframe.functions import solar
from gustframe.operators.sun import with_sun


def test_published_example(spark):
    """The example of NREL/TP-560-34302: 17 October 2003, 12:30:30 local time (UTC-7), 1830.14 m, 820 hPa, 11 degrees."""
    d = spark.sql("select timestamp'2003-10-17 19:30:30' as ts, 39.742476D as lat, -105.1786D as lon, 1 as __sun, 'x' as sun")
    got = with_sun(d, "ts", "lat", "lon", 1830.14, 82000.0, 11.0)
    assert got.columns == ["ts", "lat", "lon", "__sun", "sun"]
    row = got.first()
    assert row["__sun"] == 1
    assert row["sun"]["apparent_zenith"] == pytest.approx(50.11162, abs=3e-5)
    assert row["sun"]["azimuth"] == pytest.approx(194.34024, abs=3e-5)
    assert row["sun"]["declination"] == pytest.approx(-9.316179, abs=3e-5)
    assert row["sun"]["distance"] == pytest.approx(0.9965422974, abs=3e-5)


def test_near_the_coarse_series_and_nulls(spark):
    d = spark.range(4000).select((F.lit(1577836800) + F.col("id") * 9377).cast("timestamp").alias("ts"), (F.col("id") % 120 - 60).cast("double").alias("lat"), (F.col("id") * 7 % 360 - 180).cast("double").alias("lon"))
    both = with_sun(d, "ts", "lat", "lon").withColumn("coarse", solar.position("ts", "lat", "lon"))
    off = both.select(F.abs(F.col("sun.zenith") - F.col("coarse.zenith")).alias("z"), (F.col("sun.apparent_zenith") > F.col("sun.zenith") + 1e-9).alias("sunk"))
    assert off.agg(F.max("z")).first()[0] < 0.02
    assert off.filter("sunk").count() == 0
    odd = spark.createDataFrame([(None, 50.0, 8.0), ("2020-06-01 12:00:00", None, 8.0), ("2020-06-01 12:00:00", 50.0, None), ("2020-06-01 12:00:00", 90.0, 0.0)], "t string, lat double, lon double")
    rows = with_sun(odd.withColumn("ts", F.col("t").cast("timestamp")), "ts", "lat", "lon").collect()
    assert [r["sun"]["zenith"] is None for r in rows] == [True, True, True, False]
    assert rows[3]["sun"]["zenith"] == pytest.approx(90 - 22.13, abs=0.05)
    assert with_sun(odd.limit(0).withColumn("ts", F.col("t").cast("timestamp")), "ts", "lat", "lon").count() == 0


def test_each_angle_once(spark):
    d = spark.range(10).select(F.col("id").cast("timestamp").alias("ts"))
    plan = with_sun(d, "ts", F.lit(50.0), F.lit(8.0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("AGGREGATE(") == 7
    assert "Python" not in plan


def test_plan_with_the_fine_sun(spark):
    from gustframe.config import PvParams
    from gustframe.plans.pv import simulate

    w = spark.range(24).select(F.lit("a").alias("station_id"), (F.lit(1590969600) + F.col("id") * 3600).cast("timestamp").alias("timestamp"), *[F.lit(v).alias(c) for c, v in {"ghi": 12.0, "dhi": 6.0, "temperature_2m": 15.0, "wind_speed": 3.0}.items()])
    sites = spark.createDataFrame([("a", 50.0, 8.0)], "station_id string, latitude double, longitude double")
    coarse, fine = (simulate(w, sites, PvParams(planes=((35.0, 180.0),)), fine_sun=f) for f in (False, True))
    assert coarse.columns == fine.columns
    (n, z, p), (n2, z2, p2) = (d.agg(F.count("*"), F.sum("solar_zenith"), F.sum("power")).first() for d in (coarse, fine))
    assert n == n2 == 24 and z2 == pytest.approx(z, abs=24 * 0.02) and z2 != z
    assert p > 0 and p2 == pytest.approx(p, rel=0.01)
