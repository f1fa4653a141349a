"""Photovoltaic power of planes, from station irradiance and aerosol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.config import PvParams
from gustframe.functions import solar
from gustframe.operators.asof import CHUNK_SECONDS, asof_backward
from gustframe.operators.impute import impute, impute_in_blocks
from gustframe.operators.quality import complete_enough
from gustframe.operators.relational import with_grid
from gustframe.operators.sequences import ageing, ageing_from, drawn_dust, dusts
from gustframe.operators.sun import with_sun
from gustframe.operators.timegrid import resample

WEATHER = ["ghi", "dhi", "temperature_2m", "wind_speed", "precipitation_rate", "precipitation_duration"]


def prepare(stations: DataFrame, aerosol: DataFrame | None = None, threshold: float = 1.0, hourly: bool = True, long_series: bool = False, by: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """Series with something in every column, imputed, hourly (rates are summed, durations averaged), with the last aerosol, imputed again. long_series: no task
    holds a series while it is imputed."""
    fill = impute_in_blocks if long_series else impute
    df = fill(complete_enough(stations, by, WEATHER, threshold, never_empty=True), by, ts, WEATHER)
    if hourly:
        # The grid can have ten times the rows that were imputed. Partitions put together by the size of these would be too large for
        # the sorts that follow, which then spill; so there are as many as the session says.
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
        df = resample(df, by, ts, {c: "sum" if c == "precipitation_rate" else "mean" for c in WEATHER})
    if aerosol is not None:
        dense = resample(aerosol, by, ts, {"pm2_5": "mean", "pm10": "mean"})
        df = asof_backward(df, dense, by, ts, ["pm2_5", "pm10"], clip=True, chunk=None if hourly else CHUNK_SECONDS)
        df = fill(df, by, ts, [*WEATHER, "pm2_5", "pm10"], zero=0.0)
    return df


def simulate(weather: DataFrame, sites: DataFrame, params: PvParams, by: str = "station_id", ts: str = "timestamp", commissioned: Column | None = None, compat: bool = False, start_age: Column | None = None, fine_sun: bool = False) -> DataFrame:
    """(by, ts, tilt, azimuth, direct, diffuse, power) for every row and plane.

    sites: (by, latitude, longitude). start_age: years at the first stamp (drawn_age(), real_age()), where no date is known. What doesn't depend on the plane is computed before the planes multiply the rows.
    compat: dust takes what it should leave. params.soiling: velocity, step_minutes, threshold, cleaning, and the dust that a plane
    begins with: start, or with seed a draw for each plane. fine_sun: the sun's place to 0.0005 degrees instead of 0.01, at some ten times
    the work a row.
    """
    spark = weather.sparkSession
    df = weather.join(sites, by)
    if commissioned is not None:
        df = ageing(df, by, ts, commissioned, params.annual_degradation)
    elif start_age is not None:
        df = ageing_from(df, by, ts, start_age, params.annual_degradation)
    else:
        df = df.withColumn("degradation", F.lit(1.0))
    if params.soiling:
        # Before anything is derived and before planes multiply the rows: the scan deals out whole rows, so here a row travels once
        # for all planes, and is narrowest.
        s = params.soiling
        series = {}
        for i, (tilt, azimuth) in enumerate(params.planes):
            start = drawn_dust(by, F.lit(float(tilt)), F.lit(float(azimuth)), seed=int(s["seed"])) if "seed" in s else s.get("start", 4.0)
            series[f"__dust{i}"] = (solar.deposition(F.col("pm10") * 1e3, s["velocity"], s["step_minutes"] * 60, F.lit(float(tilt))), start)
        df = dusts(df, [by], ts, "precipitation_rate", "precipitation_duration", series, s["threshold"], s["cleaning"], s["step_minutes"])
        df = df.withColumn("__dusts", F.array(*series)).drop(*series)
    df = with_sun(df, ts, "latitude", "longitude") if fine_sun else df.withColumn("sun", solar.position(F.col(ts), "latitude", "longitude"))
    df = df.withColumns({"solar_zenith": F.col("sun.zenith"), "solar_azimuth": F.col("sun.azimuth")}).drop("sun")
    df = df.withColumns({"ghi": solar.watts("ghi"), "dhi": solar.watts("dhi")})
    df = df.withColumns({"dni": solar.direct_normal("ghi", "dhi", "solar_zenith"), "extra": solar.extraterrestrial(ts)})
    planes = spark.createDataFrame([(i, *p) for i, p in enumerate(params.planes, 1)], "__plane int, tilt double, azimuth double")
    df = with_grid(df, planes)
    poa = solar.plane_of_array("ghi", "dhi", "dni", "extra", "solar_zenith", "solar_azimuth", "tilt", "azimuth", params.albedo)
    df = df.withColumns({"direct": poa["direct"], "diffuse": poa["diffuse"], "poa": poa["global"]})
    df = df.withColumn("cell", solar.cell_temperature("poa", "temperature_2m", "wind_speed", params.u0, params.u1))
    dc = solar.dc_power("poa", "cell", params.dc_rating, params.gamma) * F.col("degradation")
    df = df.withColumn("dc", dc)
    if params.soiling:
        df = df.withColumn("dust", F.element_at("__dusts", F.col("__plane")))
        df = df.withColumn("dc", solar.soiled("dc", "dust", compat))
    ac = solar.ac_power("dc", params.dc_rating / params.dc_ac_ratio, params.eta_nominal, params.eta_reference)
    return df.withColumn("power", ac).drop("dc", "cell", "poa", "extra", "degradation", "__dusts", "__plane")
