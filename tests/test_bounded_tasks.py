"""Work that is dealt out by its rows, whatever files they come from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gustframe.operators import curves
from gustframe.operators.asof import asof_backward
from gustframe.operators.timegrid import resample
from gustframe.plans import catalogue


def test_points_of_one_file_are_dealt_out(spark, monkeypatch):
    each = [(f"t{i}", k / 10, float(k**3 + i)) for i in range(60) for k in range(1, 8)]
    points = spark.createDataFrame(each, "turbine string, wind_speed double, power_w double").coalesce(1)
    whole = sorted(map(tuple, curves.spline_curves(points).collect()))
    monkeypatch.setattr(curves, "POINT_ROWS", 50)
    out = curves.spline_curves(points)
    assert sorted(map(tuple, out.collect())) == whole
    sizes = [r["n"] for r in out.select("turbine", F.spark_partition_id().alias("p")).distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 30


def test_one_row_stands_for_a_run_of_empty_bins(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(hours=h, minutes=5), float(h)) for s, hours in (("a", (0, 1, 3, 500)), ("b", (7,)), (None, (0, 90))) for h in hours]
    right = spark.createDataFrame(rows, "station_id string, timestamp timestamp, pm double")
    left = spark.createDataFrame([(s, start + dt.timedelta(hours=h)) for s in ("a", "b", None) for h in range(0, 520, 3)], "station_id string, timestamp timestamp")
    every, first = (resample(right, "station_id", "timestamp", {"pm": "mean"}, fill=f) for f in (True, "first"))
    assert every.count() == 501 + 1 + 91 and first.count() == 6 + 1 + 3
    met = [sorted(map(tuple, asof_backward(left, r, "station_id", "timestamp", ["pm"]).collect()), key=repr) for r in (every, first)]
    assert met[0] == met[1]


def test_asof_resampled_meets_no_more_than_two_rows_a_bin(spark):
    df = catalogue.queries()["q_asof_resampled"](spark, "/root/testdata/sf0.001")
    assert "least(" in df._jdf.queryExecution().optimizedPlan().toString()
