"""One series with nine tenths of the rows: results as of a loop, work spread over the tasks."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustframe.operators.asof import asof_backward, clip_to_range
from gustframe.operators.sequences import drawn_dust, dust, dusts, inertia
from gustframe.operators.timegrid import resample
from gustframe.plans import catalogue

START = dt.datetime(2024, 1, 1)
DATA = "/root/testdata/sf0.001"


def _stamps(dice, n, hours):
    return sorted(START + dt.timedelta(seconds=dice.randrange(3600 * hours)) for _ in range(n))


def _table(spark, sizes, hours, seed, value="v"):
    dice = random.Random(seed)
    rows = [(s, t, None if dice.random() < 0.1 else float(dice.randrange(50)), i) for s, n in sizes.items() for i, t in enumerate(_stamps(dice, n, hours))]
    return spark.createDataFrame(rows, f"station_id string, timestamp timestamp, {value} double, n int"), rows


def _asof_slowly(left, right, clip):
    out = []
    for s, t, x, n in left:
        met = [r for r in right if r[0] == s and t is not None and r[1] is not None]
        before = [r for r in met if r[1] <= t]
        if clip and (not before or t > max(r[1] for r in met)):
            continue
        best = max(before, key=lambda r: (r[1], r[2] is not None, r[2] or 0.0)) if before else None
        out.append((s, t, x, n, best[2] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clip", [False, True])
@pytest.mark.parametrize("chunk", [3600 * 5, 7 * 86_400, None])
def test_asof_like_a_loop(spark, clip, chunk):
    left, l_rows = _table(spark, {"a": 200, "b": 12, "no": 3, None: 5}, 24 * 40, 1, "x")
    # The right side has a gap of weeks, ends before the left one and has stamps of several rows.
    right, r_rows = _table(spark, {"a": 30, "b": 4, None: 4}, 24 * 6, 2, "w")
    r_rows += [(s, t + dt.timedelta(days=20), w, n) for s, t, w, n in r_rows[:8]] + [("b", r_rows[0][1], 99.0, 0), ("b", r_rows[0][1], None, 0), ("a", None, 1.0, 0)]
    l_rows += [("a", None, 0.0, 0), ("a", r_rows[3][1], 0.0, 1), ("b", dt.datetime(2031, 5, 5), 0.0, 2), ("b", dt.datetime(1999, 5, 5), 0.0, 3)]
    left, right = spark.createDataFrame(l_rows, left.schema), spark.createDataFrame(r_rows, right.schema)
    got = asof_backward(left, right.drop("n"), "station_id", "timestamp", ["w"], clip=clip, chunk=chunk)
    # A null series is one like others.
    assert sorted(map(tuple, got.collect()), key=repr) == _asof_slowly(l_rows, r_rows, clip)


def test_asof_takes_the_latest_forecast_across_chunks(spark):
    t = [START + dt.timedelta(days=d) for d in range(40)]
    right = spark.createDataFrame([("a", t[2], 1.0, 5), ("a", t[2], 2.0, 3), ("a", t[30], 7.0, 1)], "station_id string, timestamp timestamp, w double, run int")
    left = spark.createDataFrame([("a", x) for x in t], "station_id string, timestamp timestamp")
    got = [r["w"] for r in asof_backward(left, right, "station_id", "timestamp", ["w"], "run").orderBy("timestamp").collect()]
    assert got == [None] * 2 + [1.0] * 28 + [7.0] * 10


def test_asof_of_empty_sides(spark):
    left, rows = _table(spark, {"a": 3}, 5, 3, "x")
    right = left.select("station_id", "timestamp", F.col("x").alias("w"))
    assert [r["w"] for r in asof_backward(left, right.limit(0), "station_id", "timestamp", ["w"]).collect()] == [None] * 3
    assert asof_backward(left, right.limit(0), "station_id", "timestamp", ["w"], clip=True).count() == 0
    assert asof_backward(left.limit(0), right, "station_id", "timestamp", ["w"]).count() == 0


def _tasks(df):
    """In how many tasks the hot series' rows come out, and the largest share of one."""
    sizes = [r["count"] for r in df.filter("station_id = 'a'").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return len(sizes), max(sizes) / sum(sizes)


def test_a_hot_series_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df, _ = _table(spark, {"a": 3000, "b": 300}, 24 * 300, 4)
        found = asof_backward(df, df.select("station_id", "timestamp", F.col("v").alias("w")), "station_id", "timestamp", ["w"])
        washed = dust(df.withColumn("m", F.lit(1.0)), ["station_id"], "timestamp", "v", "m", "v", 4.0, 40.0, 0.5, 10)
        for out in (found, washed):
            tasks, share = _tasks(out)
            assert tasks == 4 and share < 0.5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bins_are_summed_before_they_travel(spark):
    df, _ = _table(spark, {"a": 900, "b": 100, None: 9}, 200, 5)
    for origin in ("start", "midnight"):
        whole = resample(df, "station_id", "timestamp", {"v": "mean"}, origin=origin)
        partly = resample(df, "station_id", "timestamp", {"v": "mean"}, origin=origin, partial=True)
        rounded = [sorted(((r[0], r[1], r[2] and round(r[2], 9)) for r in x.collect()), key=repr) for x in (whole, partly)]
        assert rounded[0] == rounded[1]
    plan = partly._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    dealt = [i for i, x in enumerate(plan) if "Exchange hashpartitioning(station_id" in x and "__bin" in x]
    assert len(dealt) == 1 and "partial_avg(v" in plan[dealt[0] + 1], plan
    assert resample(df.limit(0), "station_id", "timestamp", {"v": "mean"}, partial=True).count() == 0


def _inertia_slowly(rows):
    tail, before, out = 0.0, None, []
    for p, v in rows:
        if before is not None:
            tail = tail * np.exp(-600 / max(300, 1200 * (1 + 0.1 * (3 - v)))) if p < before else p
        out.append(p if before is None else tail)
        before = p
    return out


def test_inertia_like_a_loop(spark):
    dice = random.Random(6)
    rows = [(s, t, float(dice.randrange(9)), dice.random() * 12) for s in ("a", None) for t in sorted(set(_stamps(dice, 150, 24 * 60)))]
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp, p double, v double")
    got = inertia(df, "station_id", "timestamp", "p", "v", 600, 1200, 0.1, 3, 300).orderBy("timestamp").collect()
    for s in ("a", None):
        want = _inertia_slowly([(p, v) for k, _, p, v in rows if k == s])
        assert [r["smoothed"] for r in got if r["station_id"] == s] == pytest.approx(want)


def test_dust_may_begin_with_a_draw(spark):
    df = spark.range(3000).selectExpr("cast(id % 1500 as string) as s", "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id div 1500 as int) * 30) as t", "0.0 as r", "0.0 as m", "1.0 as d")
    got = dust(df, ["s"], "t", "r", "m", "d", drawn_dust("s", seed=7), 1.0, 0.5, 10).collect()
    first = {r["s"]: r["dust"] for r in got if r["t"] == START}
    assert all(r["dust"] == pytest.approx(first[r["s"]] + 1) for r in got if r["t"] != START)
    own = np.array(list(first.values()))
    assert own.min() >= 0 and abs(own.mean() - 4) < 0.15 and abs(own.std() - 1) < 0.1


def _final(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name,scans,imputed", [("q_soiling_rows", 1, 0), ("q_inertia", 1, 0), ("q_pv_plan_soiled", 2, 1)])
def test_scans_run_what_comes_before_them_once(spark, name, scans, imputed):
    plan = _final(catalogue.queries()[name](spark, DATA))
    assert plan.count("FileScan") == scans
    assert plan.count("FlatMapGroupsInArrow") == imputed and "FlatMapGroupsInPandas" not in plan
    assert "ReusedExchange" in plan


def test_a_scan_over_rows_that_lie_by_series_runs_them_once(spark):
    """Rows that a window has dealt out by series need no exchange for the chunks, which must still be put together once."""
    df, _ = _table(spark, {"a": 300, "b": 30}, 24 * 60, 8)
    numbered = df.withColumns({"i": F.row_number().over(W.partitionBy("station_id").orderBy("timestamp")), "m": F.lit(1.0)})
    plan = _final(dust(numbered, ["station_id"], "timestamp", "v", "m", "v", 4.0, 40.0, 0.5, 10))
    assert plan.count("row_number()") == 1 and "ReusedExchange" in plan, plan


def test_planes_share_a_scan(spark):
    df, _ = _table(spark, {"a": 200, "b": 20, None: 9}, 24 * 40, 9)
    df = df.withColumns({"m": F.lit(3.0), "w": F.col("v") / 7})
    both = dusts(df, ["station_id"], "timestamp", "v", "m", {"x": (F.col("v"), 4.0), "y": (F.col("w"), drawn_dust("station_id", F.lit(35.0), seed=7))}, 40.0, 0.5, 10)
    for name, settled, start in (("x", "v", 4.0), ("y", "w", drawn_dust("station_id", F.lit(35.0), seed=7))):
        alone = dust(df, ["station_id"], "timestamp", "v", "m", settled, start, 40.0, 0.5, 10).withColumnRenamed("dust", name)
        got, want = (sorted(map(tuple, x.select(*df.columns, name).collect()), key=repr) for x in (both, alone))
        assert len(got) == 229 and got == want


@pytest.mark.parametrize("joined", ["10MB", "-1"])
def test_rows_travel_once_for_all_planes(spark, joined):
    """The scan deals rows out before planes multiply them, once, also where what chunks begin with is too large to be sent."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)
    try:
        plan = _final(catalogue.queries()["q_pv_plan_soiled"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("BroadcastNestedLoopJoin") < plan.index("REPARTITION_BY_COL") and plan.count("REPARTITION_BY_COL") == 2, plan
    lines = plan.split("\n")
    # Between the join that hands each chunk its first value and the exchange of the chunks there is no other.
    at = next(i for i, x in enumerate(lines) if "REPARTITION_BY_COL" in x)
    join = max(i for i, x in enumerate(lines[:at]) if "Join" in x)
    assert "__begun" in lines[join] and not any("Exchange" in x for x in lines[join:at]), plan


def test_the_hourly_grid_has_as_many_partitions_as_the_session(spark):
    """Few and small rows become many hours, so partitions aren't put together by the size of what is imputed."""
    plan = _final(catalogue.queries()["q_pv_plan_soiled"](spark, DATA)).split("\n")
    at = next(i for i, x in enumerate(plan) if "FlatMapGroupsInArrow" in x)
    dealt = max(i for i, x in enumerate(plan[:at]) if "Exchange" in x)
    assert "REPARTITION_BY_NUM" in plan[dealt] and "hashpartitioning(station_id" in plan[dealt], plan
    assert not any("AQEShuffleRead" in x for x in plan[dealt - 2 : dealt]), plan
