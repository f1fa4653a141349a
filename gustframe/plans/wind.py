"""Wind power of parks. One long plan serves all inputs: a variant is the source of the shear exponent and the units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustframe.functions import atmosphere as air
from gustframe.functions import wind
from gustframe.functions.nulls import round_even
from gustframe.functions.times import in_days
from gustframe.operators.asof import CHUNK_SECONDS, asof_backward
from gustframe.operators.curves import interpolated
from gustframe.operators.impute import impute, impute_in_blocks
from gustframe.operators.quality import complete_enough
from gustframe.operators.relational import sent_if_small, with_grid
from gustframe.operators.sequences import ageing, ageing_from
from gustframe.operators.timegrid import resample

WEATHER = ["wind_speed", "temperature_2m", "relative_humidity", "std_v_wind", "pressure", "wind_direction"]


@dataclass(frozen=True)
class Site:
    """How a series was measured and what is done with it."""

    shear: str = "turbulence"  # turbulence, friction, levels, or anything else for 1/7
    measured: float = 10.0
    vapour: str = "huang"
    karman: float = wind.KARMAN
    rate: float = 0.0063
    noise: float = 0.0
    seed: int = 42
    upper: tuple[str, float] | None = None  # a second level's column and height, for levels
    missing_alpha: float | None = None  # 0 where a reanalysis level has no wind
    kelvin: bool = False
    components: bool = False  # speeds come as u and v


def prepare(stations: DataFrame, vertical: DataFrame | None = None, columns: list[str] | None = None, threshold: float = 1.0, fill: bool = True, hourly: bool = True, long_series: bool = False, by: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """Complete enough series, imputed, then hourly, then with the last vertical wind at or before each hour. long_series: no task holds a
    series while it is imputed."""
    columns = columns or WEATHER
    df = complete_enough(stations, by, columns, threshold)
    if fill:
        df = (impute_in_blocks if long_series else impute)(df, by, ts, columns)
    if hourly:
        df = resample(df, by, ts, dict.fromkeys(columns, "mean"))
    if vertical is not None:
        df = asof_backward(df, vertical, by, ts, ["w_vert"], "starttime" if "starttime" in vertical.columns else None, clip=True, chunk=None if hourly else CHUNK_SECONDS)
    return df


def from_reanalysis(df: DataFrame) -> DataFrame:
    """Speeds from components, Celsius, humidity from the dew point, hPa."""
    t, d = F.col("temp_2m") - air.KELVIN, F.col("dew_point_2m") - air.KELVIN
    return df.withColumns(
        {
            "wind_speed": wind.speed("u_wind_10m", "v_wind_10m"),
            "wind_speed_100m": wind.speed("u_wind_100m", "v_wind_100m"),
            "temperature_2m": t,
            "relative_humidity": air.relative_humidity(t, d),
            "pressure": F.col("pressure") / 100,
        }
    )


def exponent(site: Site) -> Column:
    if site.shear == "turbulence":
        return wind.shear_turbulence("wind_speed", "std_v_wind", "wind_direction", "w_vert", site.karman)
    if site.shear == "friction":
        return wind.shear_friction("wind_speed", "std_v_wind", "friction_wind", site.karman)
    if site.shear == "levels" and site.upper:
        return wind.shear_levels("wind_speed", site.upper[0], site.measured, site.upper[1], missing=site.missing_alpha)
    return F.lit(wind.SEVENTH)


def simulate(weather: DataFrame, park: DataFrame, specs: DataFrame, curves: DataFrame, site: Site = Site(), by: str = "station_id", ts: str = "timestamp", commissioned: Column | None = None, hub_speeds: DataFrame | None = None, first: str | None = None, last: str | None = None, start_age: Column | None = None) -> DataFrame:
    """(weather columns, turbine_no, wind_speed_hub, temperature_hub, density_hub, cp, power) for every row and turbine.

    park: (turbine_no, turbine, hub_height, rated_kw), specs and curves: the long catalogue with next_w; all small dimensions.
    hub_speeds: (by, ts, turbine_no, wind_speed_hub) from elsewhere instead of extrapolation. commissioned: dates for ageing; start_age: years at the first stamp
    (drawn_age(), real_age()), where no date is known.
    What doesn't depend on the turbine is computed before the rows are multiplied; the curve is met by a broadcast join on a whole
    number. Ages count from each series' own first row, so the slice to [first, last] comes after.
    """
    over = W.partitionBy(by)
    df = weather.withColumn("alpha", exponent(site)) if hub_speeds is None else weather
    vap = air.vapour("temperature_2m", site.vapour)
    df = df.withColumn("saturated_vapor_pressure", vap).withColumn("density", air.moist_density(F.col("pressure") * 100, "temperature_2m", air.humidity_scale("relative_humidity", over), "saturated_vapor_pressure"))
    if commissioned is not None:
        df = ageing(df, by, ts, commissioned, site.rate)
    elif start_age is not None:
        df = ageing_from(df, by, ts, start_age, site.rate)
    else:
        df = df.withColumn("degradation", F.lit(1.0))
    if first or last:
        df = df.filter(in_days(ts, first, last))
    tops = curves.groupBy("turbine").agg(F.max("power_w").alias("curve_max"))
    dim = park.join(sent_if_small(specs.drop("rated")), "turbine").join(sent_if_small(tops), "turbine").withColumn("rated_w", wind.rating("rated_kw", "curve_max"))
    df = with_grid(df, dim)
    if hub_speeds is None:
        df = df.withColumn("wind_speed_hub", round_even(wind.power_law("wind_speed", F.col("hub_height"), site.measured, F.col("alpha"))))
    else:
        df = df.join(hub_speeds, [by, ts, "turbine_no"], "left")
    df = df.withColumn("temperature_hub", air.temperature_at("temperature_2m", F.col("hub_height"))).withColumn("density_hub", air.density_at("density", "temperature_2m", F.col("hub_height")))
    df = interpolated(df, curves, "wind_speed_hub", degradation=F.col("degradation"))
    df = df.withColumn("cp", wind.power_coefficient("curve_w", "wind_speed_hub", "diameter"))
    power = wind.turbine_power("wind_speed_hub", "cp", "density_hub", "diameter", "cut_in", "cut_out", "rated_w")
    df = df.withColumn("power", wind.noisy(power, "rated_w", site.noise, site.seed, by, ts) if site.noise else power)
    return df.drop("curve_w", "curve_max", "degradation")


def wide(df: DataFrame, ids: list[str], turbines: list[int]) -> DataFrame:
    """The layout of result files: one column for each quantity and turbine."""
    from gustframe.operators.reshape import widen

    return widen(df, ids, "turbine_no", ["wind_speed_hub", "temperature_hub", "density_hub", "cp", "power"], turbines)
