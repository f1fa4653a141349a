"""Power curves: splines through a catalogue's points, lookup by broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.functions.nulls import clip, col, div
from gustframe.functions.wind import equivalent_speed
from gustframe.operators.relational import sent_if_small


#: Ticks of a catalogue that may be sent to every executor (about 40 MB).
CATALOGUE_TICKS = 1_000_000
#: Ticks that a task hands on at a time.
CURVE_ROWS = 100_000
#: Points that a task gathers into curves.
POINT_ROWS = 100_000


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y) whose third derivative is continuous at the second and the last but one point (de Boor)."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        b[i] = 3 * (h[i] * slope[i - 1] + h[i - 1] * slope[i])
    a[0, :2] = h[1], h[0] + h[1]
    b[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * slope[0] + h[0] ** 2 * slope[1]) / (h[0] + h[1])
    a[-1, -2:] = h[-1] + h[-2], h[-2]
    b[-1] = (h[-1] ** 2 * slope[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * slope[-1]) / (h[-1] + h[-2])
    d = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t, w = at - x[i], h[i]
    c2 = (3 * slope[i] - 2 * d[i] - d[i + 1]) / w
    c3 = (d[i] + d[i + 1] - 2 * slope[i]) / w**2
    return y[i] + t * (d[i] + t * (c2 + t * c3))


def dense_curves(spark: SparkSession, points: dict[str, tuple[list[float], list[float]]], rated: dict[str, float] | None = None) -> DataFrame:
    """(turbine, ws_c, power_w, next_w) on hundredths of m/s: a cubic spline between first and last point, the last set to the
    rating, between 0 and the rating. A catalogue has hundreds of turbines with a few thousand ticks each: it is interpolated here."""
    rows = []
    for turbine, (ws, power) in points.items():
        x, y = np.asarray(ws, float), np.asarray(power, float)
        ticks = np.arange(int(round(x[0] * 100)), int(round(x[-1] * 100)) + 1)
        top = (rated or {}).get(turbine, float(y.max()))
        p = np.clip(cubic(x, y, ticks / 100), 0, top)
        p[-1] = top
        below = np.zeros(ticks[0])
        p = np.concatenate((below, p))
        rows += [(turbine, i, float(v), float(p[min(i + 1, len(p) - 1)])) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "turbine string, ws_c int, power_w double, next_w double")


def spline_curves(points: DataFrame, rated: DataFrame | None = None, turbine: str = "turbine", speed: str = "wind_speed", power: str = "power_w") -> DataFrame:
    """dense_curves() of a table of points, a row each: a curve is solved by the task that has its points, so a catalogue of any size
    is spread. rated: (turbine, rated_w); a curve without one ends at its highest point. Points without speed or power don't count, of
    several at one speed the highest does; a curve of one point is that tick, with nothing below it.

    The points are counted and dealt out by curve, about POINT_ROWS to a task, before any are held: files of a catalogue are small,
    so one task may read, and would hold, all of them."""
    parts = points.count() // POINT_ROWS + 1
    own = points.repartition(parts, turbine).filter(F.col(speed).isNotNull() & F.col(power).isNotNull()).groupBy(turbine, F.rint(F.col(speed) * 100).cast("int").alias("x")).agg(F.max(F.col(power).cast("double")).alias("y"))
    held = own.groupBy(turbine).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    known = held.join(rated.select(F.col(turbine).alias("__t"), F.col("rated_w").cast("double").alias("top")), F.col(turbine).eqNullSafe(F.col("__t")), "left").drop("__t") if rated is not None else held.withColumn("top", F.lit(None).cast("double"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, power_w, next_w, sizes = 0, [], [], []
            for i, (p, top) in enumerate(zip(batch.column("p").to_pylist(), batch.column("top").to_pylist(), strict=True)):
                x, y = np.array([q["x"] for q in p]), np.array([q["y"] for q in p])
                top = float(y.max()) if top is None else top
                w = np.clip(cubic(x / 100, y, np.arange(x[0], x[-1] + 1) / 100), 0, top) if len(x) > 1 else np.array([top])
                w[-1] = top
                w = np.concatenate((np.zeros(x[0]), w))
                power_w.append(w)
                next_w.append(np.append(w[1:], w[-1]))
                sizes.append(len(w))
                if sum(sizes) >= CURVE_ROWS or i == batch.num_rows - 1:
                    names = batch.column(turbine).take(pa.array(np.repeat(np.arange(at, i + 1), sizes)))
                    ticks = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                    yield pa.RecordBatch.from_arrays([names, pa.array(ticks), pa.array(np.concatenate(power_w)), pa.array(np.concatenate(next_w))], names=[turbine, "ws_c", "power_w", "next_w"])
                    at, power_w, next_w, sizes = i + 1, [], [], []

    schema = T.StructType([known.schema[turbine], T.StructField("ws_c", T.IntegerType()), T.StructField("power_w", T.DoubleType()), T.StructField("next_w", T.DoubleType())])
    return known.select(turbine, "p", "top").mapInArrow(solve, schema)


def with_next(curves: DataFrame, by: str = "turbine", index: str = "ws_c", power: str = "power_w") -> DataFrame:
    """Long curves with the power at the next tick, for interpolation in a lookup."""
    w = W.partitionBy(by).orderBy(index)
    return curves.withColumn("next_w", F.coalesce(F.lead(power).over(w), F.col(power)))


def interpolated(df: DataFrame, curves: DataFrame, speed: Column | str, turbine: str = "turbine", name: str = "curve_w", degradation: Column | float = 1.0) -> DataFrame:
    """df with the curve's power at a speed, between ticks in proportion, clamped at the curve's ends.

    An aged curve stretches the speeds, which is the same as shrinking the speed looked up: one broadcast join on a whole number
    instead of a curve for every row. A null speed gives null."""
    v = equivalent_speed(speed, degradation) * 100
    last = curves.groupBy(turbine).agg(F.max("ws_c").alias("__last"), F.min("ws_c").alias("__low"))
    dim = curves.select(F.col(turbine).alias("__t"), F.col("ws_c").alias("__k"), F.col("power_w").alias("__p"), F.col("next_w").alias("__q"))
    # A catalogue of four hundred turbines has a million ticks: sent if it is no larger, else joined by a shuffle.
    ends, dim = sent_if_small(last.withColumnRenamed(turbine, "__e")), sent_if_small(dim, CATALOGUE_TICKS)
    own = df.withColumn("__v", v).join(ends, F.col(turbine) == F.col("__e"), "left")
    own = own.withColumn("__v", clip("__v", F.col("__low").cast("double"), F.col("__last").cast("double"))).withColumn("__f", F.floor("__v").cast("int"))
    joined = own.join(dim, (F.col(turbine) == F.col("__t")) & (F.col("__f") == F.col("__k")), "left")
    value = F.col("__p") + (F.col("__q") - F.col("__p")) * (F.col("__v") - F.col("__f"))
    return joined.withColumn(name, value).drop("__v", "__e", "__last", "__low", "__f", "__t", "__k", "__p", "__q")


def at_ticks(df: DataFrame, curves: DataFrame, tick: Column | str, turbine: str = "turbine", name: str = "curve_w") -> DataFrame:
    """Left lookup at a whole tick; null off the curve."""
    dim = curves.select(F.col(turbine).alias("__t"), F.col("ws_c").alias("__k"), F.col("power_w").alias(name))
    own = df.withColumn("__f", col(tick))
    return own.join(sent_if_small(dim, CATALOGUE_TICKS), (F.col(turbine) == F.col("__t")) & (F.col("__f") == F.col("__k")), "left").drop("__t", "__k", "__f")


def interp(x: Column | str, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through a few fixed points, clamped at the ends."""
    c, pts = col(x), sorted(points)
    out = F.lit(float(pts[-1][1]))
    for (a, p), (b, q) in reversed(list(zip(pts, pts[1:], strict=False))):
        out = F.when(c <= b, p + (q - p) * div(c - a, F.lit(float(b - a)))).otherwise(out)
    return F.when(c.isNotNull(), F.when(c <= pts[0][0], F.lit(float(pts[0][1]))).otherwise(out))
