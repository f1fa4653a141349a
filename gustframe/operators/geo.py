"""Distances, and nearest points by them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.functions.nulls import col
from gustframe.operators.relational import sent_if_small

RADIUS_KM = 6371.0088


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """km on a sphere; within 0.5 % of the ellipsoid, enough to rank."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), F.lit(2.0))
    return 2 * RADIUS_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


@F.pandas_udf(T.DoubleType())
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """km on the WGS-84 ellipsoid by Vincenty's inverse formula; NaN for nearly antipodal points, where it doesn't converge."""
    import numpy as np

    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
    length = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam, done = length.copy(), np.zeros(len(length), bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s == 0, 1, sin_s))
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2_a == 0, 1, cos2_a))
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = length + (1 - c) * f * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        u = cos2_a * (a**2 - b**2) / b**2
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        delta = small * sin_s * (cos_2m + small / 4 * (cos_s * (2 * cos_2m**2 - 1) - small / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
        km = b * big * (sigma - delta)
    return pd.Series(np.where(done, km, math.nan))


#: Halvings of 180 degrees: the finest cells are 300 m high.
LEVELS = 16
#: Columns of cells that a search may span; nearer to the poles coarser cells are taken.
WIDE = 16


def _cell(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Row and column of the finest cell."""
    last = 2**LEVELS - 1
    i = F.least(F.floor((latitude + 90) * (2**LEVELS / 180)).cast("long"), F.lit(last))
    return F.greatest(i, F.lit(0)), F.least(F.floor(F.pmod(longitude + 180, F.lit(360.0)) * (2**LEVELS / 180)).cast("long"), F.lit(2 * last + 1))


def _at_levels(df: DataFrame, i: str, j: str) -> DataFrame:
    """df once for each level, with the row and column of its cell there."""
    each = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    return each.withColumns({c: F.expr(f"shiftright({c}, {LEVELS} - level)") for c in (i, j)})


def _reach(level: Column) -> Column:
    """An angle within which the other points of a cell lie from any place in it: neither side is longer than the cell is high."""
    return 2 * F.asin(F.least(F.radians(F.lit(180.0)) / F.pow(F.lit(2.0), level) / math.sqrt(2), F.lit(1.0)))


def _half_width(latitude: Column, reach: Column) -> Column:
    """Degrees of longitude that an angle takes at a latitude; 180 where it spans a pole."""
    over = F.abs(F.radians(latitude)) + reach >= math.pi / 2
    return F.when(over, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(reach) / F.cos(F.radians(latitude)), F.lit(1.0)))))


def nearest(df: DataFrame, points: DataFrame, by: str, k: int = 1, at: tuple[str, str] = ("latitude", "longitude"), of: tuple[str, str] = ("p_latitude", "p_longitude"), tie: str | None = None) -> DataFrame:
    """For each place of df its k nearest points with `distance` (km) and `rank`; all, where there are fewer than k.

    The sphere is cut into cells at LEVELS levels. A place takes the finest level at which its own cell has k points: the k-th nearest is
    no farther than the cell is long, so all candidates are in the cells within that reach, which places and points meet in by
    equality. Places or points without coordinates meet nothing. Of points at one distance that with the smaller `tie` comes first.
    """
    tie = tie or [c for c in points.columns if c not in of][0]
    pi, pj = _cell(F.col(of[0]), F.col(of[1]))
    own = points.filter(F.col(of[0]).isNotNull() & F.col(of[1]).isNotNull())
    known = own.select(F.struct(*points.columns).alias("p"), pi.alias("i"), pj.alias("j"))
    placed = _at_levels(known, "i", "j")
    full = placed.groupBy("level", "i", "j").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("level", "i", "j")
    qi, qj = _cell(F.col(at[0]), F.col(at[1]))
    rows = df.select(by, *at).filter(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()).distinct()
    rows = rows.select(F.col(by).alias("key"), F.col(at[0]).alias("lat"), F.col(at[1]).alias("lon"), qi.alias("i"), qj.alias("j"))
    found = _at_levels(rows, "i", "j").join(sent_if_small(full), ["level", "i", "j"]).groupBy("key", "lat", "lon").agg(F.max("level").alias("level"))
    # Places in whose half of the world there are fewer than k points look everywhere.
    every = rows.select("key", "lat", "lon").join(found, ["key", "lat", "lon"], "left")
    lat, lon = F.col("lat"), F.pmod(F.col("lon") + 180, F.lit(360.0))
    narrow = F.filter(F.sequence(F.lit(0), F.col("level")), lambda q: _half_width(lat, _reach(q)) * 2 * F.pow(F.lit(2.0), q) / 180 <= WIDE)
    search = every.withColumn("level", F.when(F.col("level").isNotNull(), F.coalesce(F.array_max(narrow), F.lit(0))))
    reach = F.when(F.col("level").isNull(), math.pi).otherwise(_reach(F.col("level")))
    search = search.withColumn("reach", reach).withColumn("level", F.coalesce("level", F.lit(0))).withColumns({"half": _half_width(lat, F.col("reach")), "high": F.lit(180.0) / F.pow(F.lit(2.0), F.col("level"))})
    # A hair more on either side, for what rounding may take.
    up = F.degrees(F.col("reach")) * (1 + 1e-9)
    low, high = (F.least(F.greatest(F.floor((lat + 90 + s * up) / F.col("high")), F.lit(0)), F.pow(F.lit(2.0), F.col("level")) - 1).cast("long") for s in (-1, 1))
    columns = (2 * F.pow(F.lit(2.0), F.col("level"))).cast("long")
    west = F.floor((lon - F.col("half") * (1 + 1e-9)) / F.col("high")).cast("long")
    east = F.least(F.floor((lon + F.col("half") * (1 + 1e-9)) / F.col("high")).cast("long"), west + columns - 1)
    cells = search.withColumns({"i": F.explode(F.sequence(low, high))}).withColumn("j", F.explode(F.transform(F.sequence(west, east), lambda c: F.pmod(c, columns))))
    met = cells.select("key", "lat", "lon", "level", "i", "j").join(sent_if_small(placed), ["level", "i", "j"])
    met = met.select(F.col("key").alias(by), "p.*", haversine("lat", "lon", F.col(f"p.{of[0]}"), F.col(f"p.{of[1]}")).alias("distance"))
    return met.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("distance", tie))).filter(F.col("rank") <= k)


def centroids(df: DataFrame, by: str, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    return df.groupBy(by).agg(F.avg(latitude).alias("latitude"), F.avg(longitude).alias("longitude"))
