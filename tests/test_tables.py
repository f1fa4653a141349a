"""Tables by month and by bucket, a database's table, catalogues as tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustframe.operators.asof import asof_backward
from gustframe.operators.curves import dense_curves, spline_curves
from gustframe.operators.stats import histogram, histogram_by_width, quantiles
from gustframe.operators.timegrid import resample
from gustframe.sources import files, tables
from gustframe.streaming import recent

SCHEMA = "station_id string, timestamp timestamp, v double"


def _day(d, h=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)


def _files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


@pytest.mark.parametrize("update", [True, False])
def test_a_merge_leaves_other_months_as_they_are(spark, tmp_path, update):
    path, staging = tmp_path / "t", str(tmp_path / "s")
    old = spark.createDataFrame([("a", _day(d), float(d)) for d in range(0, 120, 7)] + [("n", None, 1.0)], SCHEMA)
    tables.write_months(old, str(path), "timestamp")
    before = _files(path)
    new = spark.createDataFrame([("a", _day(35), -1.0), ("b", _day(36), -2.0), ("b", _day(36), -1.5)], SCHEMA)
    assert tables.merge_months(spark, str(path), new, ["station_id", "timestamp"], "timestamp", update, staging) == ["2024-02"]
    after = _files(path)
    same = {p for p in before if "month=2024-02" not in str(p)}
    assert same and all(after.get(p) == before[p] for p in same) and not {p for p in before if p not in same} & set(after)
    got = {(r["station_id"], r["timestamp"]): r["v"] for r in spark.read.parquet(str(path)).collect()}
    want = {(r["station_id"], r["timestamp"]): r["v"] for r in old.collect()}
    want |= {("a", _day(35)): -1.0 if update else 35.0, ("b", _day(36)): -2.0}
    assert got == want
    assert not (tmp_path / "s").exists()


def test_merges_that_begin_a_table_or_bring_nothing(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    new = spark.createDataFrame([("a", _day(0), 1.0), ("a", None, 2.0)], SCHEMA)
    assert tables.merge_months(spark, path, new.limit(0), ["station_id", "timestamp"], "timestamp", True, staging) == []
    for _ in range(2):
        tables.merge_months(spark, path, new.filter("timestamp is not null"), ["station_id", "timestamp"], "timestamp", True, staging)
        assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        tables.merge_months(spark, path, new, ["station_id"], "timestamp", True, staging)


def test_a_stream_merges_by_month(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a", _day(d, h), float(h)) for d in (0, 40) for h in range(3)] + [("a", _day(90), 0.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source))
    hourly = recent.hourly(recent.read(spark, str(source), spark.read.parquet(str(source)).schema), "station_id", "timestamp", ["v"])
    recent.merge_to(hourly, str(tmp_path / "out"), ["station_id", "timestamp"], "timestamp", str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["v"]) for r in got] == [(_day(d, h), float(h)) for d in (0, 40) for h in range(3)]
    assert {r["month"] for r in spark.read.schema("month string").parquet(str(tmp_path / "out")).collect()} == {"2024-01", "2024-02"}


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    rows = [(f"s{i % 7}", _day(i // 7, i % 5), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    try:
        # Without this the plan doesn't say which buckets a scan reads that gains nothing else from them.
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        tables.bucketed(df, "left_series", "station_id", "timestamp", 4)
        tables.bucketed(df.withColumnRenamed("v", "w"), "right_series", "station_id", "timestamp", 4)
        left, right = spark.table("left_series"), spark.table("right_series")
        found = asof_backward(left, right, "station_id", "timestamp", ["w"], chunk=None)
        grid = resample(left, "station_id", "timestamp", {"v": "mean"})
        for out in (found, grid):
            assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert all(r["v"] == r["w"] for r in found.collect()) and found.count() == 300
        one = left.filter("station_id = 's3'")
        assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 43
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        for name in ("left_series", "right_series"):
            spark.sql(f"drop table if exists {name}")


def test_registry_lines_without_an_end(spark):
    head = "00044 {:8} {:8} 44.00      52.9336    8.2370  Grossenkneten                            Niedersachsen"
    lines = [head.format("20070401", "20240501"), head.format("20070401", ""), head.format("20070230", "2024"), "Stations_id von"]
    got = files.registry_lines(spark.createDataFrame([(x, "a/wind/b") for x in lines], "line string, path string")).collect()
    assert [(r["valid_from"], r["valid_to"]) for r in got] == [(dt.date(2007, 4, 1), dt.date(2024, 5, 1)), (dt.date(2007, 4, 1), None), (None, None)]


def test_a_database_table_in_parts(spark, tmp_path):
    """Derby is among Spark's own jars."""
    url = f"jdbc:derby:memory:g{tmp_path.name};create=true"
    df = spark.range(100).selectExpr("cast(id as int) as ID", "cast(id % 7 as double) as V")
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df.write.format("jdbc").options(url=url, dbtable="SERIES", **driver).save()
    got = files.table(spark, url, "SERIES", "ID", (0, 100), 4, **driver)
    assert got.rdd.getNumPartitions() == 4
    some = got.filter("ID >= 90").select("V")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ID,90)" in plan and "ReadSchema: struct<V:double>" in plan
    assert sorted(r["V"] for r in some.collect()) == sorted(float(i % 7) for i in range(90, 100))
    assert files.table(spark, url, "SERIES", **driver).count() == 100


def test_splines_of_a_table_like_those_of_the_driver(spark):
    points = {"a": ([1.0, 2.0, 4.0, 5.0], [0.0, 10.0, 90.0, 95.0]), "b": ([0.5, 3.0, 6.5, 9.0, 12.0], [5.0, 80.0, 300.0, 420.0, 400.0]), "c": ([2.0], [7.0])}
    rows = [(t, x, y) for t, (xs, ys) in points.items() for x, y in zip(xs, ys, strict=True)] + [("a", None, 1.0), ("a", 2.0, 3.0), ("a", 3.0, None)]
    df = spark.createDataFrame(rows, "turbine string, wind_speed double, power_w double")
    rated = spark.createDataFrame([("a", 100.0)], "turbine string, rated_w double")
    got = sorted(map(tuple, spline_curves(df.repartition(3), rated).collect()))
    want = sorted(map(tuple, dense_curves(spark, {t: points[t] for t in "ab"}, {"a": 100.0}).collect())) + [("c", i, 7.0 if i == 200 else 0.0, 7.0 if i >= 199 else 0.0) for i in range(201)]
    assert [(t, i) for t, i, *_ in got] == [(t, i) for t, i, *_ in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want])
    assert spline_curves(df.limit(0)).count() == 0


def test_histograms_like_numpy(spark):
    x = np.random.default_rng(7).normal(size=500) * 40
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    edges = np.arange(np.floor(x.min() / 15), np.floor(x.max() / 15) + 2) * 15
    counts = np.histogram(x, edges)[0]
    for norm, want in {"count": counts, "density": counts / 500 / 15, "probability": counts / 500, "percent": counts / 5}.items():
        got = histogram_by_width(df, "x", 15.0, norm).orderBy("bin").collect()
        assert [r["left"] for r in got] == edges[:-1].tolist() and [r["value"] for r in got] == pytest.approx(want.tolist())
        own = [r["value"] for r in histogram(df.filter("not isnan(x)"), "x", 20, norm).orderBy("bin").collect()]
        n, cut = np.histogram(x, 20)
        assert own == pytest.approx({"count": n, "density": n / 500 / (cut[1] - cut[0]), "probability": n / 500, "percent": n / 5}[norm].tolist())
    assert histogram_by_width(df.limit(0), "x", 15.0).count() == 0


def test_quantiles_of_groups_without_key_or_numbers(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("b", float("nan")), ("c", None), ("d", 5.0)], "k string, x double")
    got = {r["k"]: (r["n"], r["q"]) for r in quantiles(df, ["k"], "x", [0.5]).collect()}
    assert got == {None: (2, [2.0]), "b": (0, None), "c": (0, None), "d": (1, [5.0])}
    assert quantiles(df.filter(F.lit(False)), ["k"], "x", [0.5]).count() == 0
