"""Sun, irradiance on planes, and the power of modules and inverters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustframe.functions.draws import normal
from gustframe.functions.nulls import clip, col, div, zero_below
from gustframe.functions.times import micros


def watts(joules_per_cm2: Column | str, seconds: int = 600) -> Column:
    """J/cm2 per interval as W/m2; less than 0.01 is 0."""
    return zero_below(col(joules_per_cm2) * 1e4 / float(seconds))


def _day_angle(ts: Column | str) -> Column:
    return F.lit(2 * math.pi / 365) * (F.dayofyear(col(ts)) - 1)


def extraterrestrial(ts: Column | str) -> Column:
    """W/m2 outside the atmosphere (Spencer 1971)."""
    b = _day_angle(ts)
    return 1366.1 * (1.00011 + 0.034221 * F.cos(b) + 0.00128 * F.sin(b) + 0.000719 * F.cos(2 * b) + 7.7e-05 * F.sin(2 * b))


def position(ts: Column | str, latitude: Column | str, longitude: Column | str) -> Column:
    """struct<zenith, azimuth>, true, in degrees, from the sun's mean elements (low-precision ephemeris, 0.01 degrees)."""
    n = micros(ts) / F.lit(86_400e6) + (2440587.5 - 2451545.0)  # days since noon of the first day of 2000

    def angle(at: float, rate: float) -> Column:
        return F.radians(F.lit(at) + rate * n)

    mean, anomaly = angle(280.460, 0.9856474), angle(357.528, 0.9856003)
    ecliptic = mean + F.radians(1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = angle(23.439, -4e-7)
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    hour = F.radians(F.lit(280.46061837) + 360.98564736629 * n + col(longitude)) - ascension
    lat = F.radians(col(latitude))
    zenith = F.acos(clip(F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(hour), -1, 1))
    azimuth = F.atan2(F.sin(hour), F.cos(hour) * F.sin(lat) - F.tan(declination) * F.cos(lat))
    return F.struct(F.degrees(zenith).alias("zenith"), F.pmod(F.degrees(azimuth) + 180, F.lit(360.0)).alias("azimuth"))


def apparent_elevation(zenith: Column | str, pressure: Column | float = 101325.0, temperature: Column | float = 12.0) -> Column:
    """Elevation in degrees with refraction (Bennett's formula for the geometric elevation, scaled by pressure in Pa and air in Celsius)."""
    e = 90 - col(zenith)
    p, t = (x if isinstance(x, Column) else F.lit(float(x)) for x in (pressure, temperature))
    lifted = (p / 101000.0) * (283.0 / (273.0 + t)) * 1.02 / (60 * F.tan(F.radians(e + 10.3 / (e + 5.11))))
    return F.when(e > -0.83337, e + lifted).otherwise(e)


def pressure_at(altitude: Column | str) -> Column:
    """Pa at an altitude in metres, standard atmosphere."""
    return 100 * F.pow((44331.514 - col(altitude)) / 11880.516, F.lit(1 / 0.1902632))


def direct_normal(ghi: Column | str, dhi: Column | str, zenith: Column | str) -> Column:
    """(ghi - dhi) / cos zenith; 0 where negative or with the sun below 2 degrees."""
    dni = div(col(ghi) - col(dhi), F.cos(F.radians(col(zenith))))
    return F.coalesce(F.when((dni >= 0) & (col(zenith) < 88), dni), F.lit(0.0))


def cos_incidence(zenith: Column | str, azimuth: Column | str, tilt: Column | str, plane: Column | str) -> Column:
    z, b = F.radians(col(zenith)), F.radians(col(tilt))
    return F.cos(b) * F.cos(z) + F.sin(b) * F.sin(z) * F.cos(F.radians(col(azimuth) - col(plane)))


def plane_of_array(ghi: Column | str, dhi: Column | str, dni: Column | str, extra: Column | str, zenith: Column | str, azimuth: Column | str, tilt: Column | str, plane: Column | str, albedo: float = 0.25) -> dict[str, Column]:
    """Direct, diffuse and global irradiance on a plane (Hay and Davies 1980); missing is 0, less than 0.01 too."""
    aoi = F.greatest(cos_incidence(zenith, azimuth, tilt, plane), F.lit(0.0))
    cos_z = F.greatest(F.cos(F.radians(col(zenith))), F.lit(0.01745))
    index = div(dni, extra)
    b = F.cos(F.radians(col(tilt)))
    sky = F.greatest(col(dhi) * (index * aoi / cos_z + (1 - index) * (1 + b) / 2), F.lit(0.0))
    ground = col(ghi) * albedo * (1 - b) / 2
    beam = col(dni) * aoi

    def clean(x: Column) -> Column:
        return zero_below(F.coalesce(x, F.lit(0.0)))

    return {"direct": clean(beam), "diffuse": clean(sky + ground), "global": clean(beam + sky + ground)}


def cell_temperature(poa: Column | str, air: Column | str, wind: Column | str, u0: float = 25.0, u1: float = 6.84) -> Column:
    """Faiman 2008."""
    return col(air) + div(poa, u0 + u1 * col(wind))


def dc_power(poa: Column | str, cell: Column | str, rating: float, gamma: float, reference: float = 25.0) -> Column:
    """PVWatts (Dobos 2014)."""
    return col(poa) / 1000 * rating * (1 + gamma * (col(cell) - reference))


def ac_power(dc: Column | str, dc_limit: float, nominal: float = 0.96, reference: float = 0.9637) -> Column:
    """PVWatts inverter: 0 without input, at most nominal * dc_limit."""
    z = col(dc) / dc_limit
    eta = nominal / reference * (-0.0162 * z - div(F.lit(0.0059), z) + 0.9858)
    return F.when(z <= 0, 0.0).otherwise(clip(eta * col(dc), 0, nominal * dc_limit))


def drawn_efficiency(mean: float, seed: int = 42, *key: Column | str) -> Column:
    """An inverter's nominal efficiency from N(mean, 0.01); without a key one draw for all."""
    return F.lit(mean) + 0.01 * normal(seed, *key)


def combined_loss(percentages: list[float]) -> float:
    """Percent lost to all of several losses together."""
    return 100 * (1 - reduce(lambda a, x: a * (1 - x / 100), percentages, 1.0))


def with_losses(power: Column | str, percentages: list[float], compat: bool = False) -> Column:
    """compat: the percentage is taken for a fraction."""
    loss = combined_loss(percentages)
    return col(power) * (1 - (loss if compat else loss / 100))


def erf(x: Column | str) -> Column:
    """Error function by Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    a = F.abs(col(x))
    t = 1 / (1 + 0.3275911 * a)
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-a * a)
    return F.signum(col(x)) * y


def soiling_loss(dust: Column | str) -> Column:
    """Share of the power that dust in g/m2 takes."""
    return 0.3434 * erf(0.17 * F.pow(col(dust), F.lit(0.8473)))


def soiled(power: Column | str, dust: Column | str, compat: bool = False) -> Column:
    """compat: the share that is lost, instead of the one that is left."""
    loss = soiling_loss(dust)
    return col(power) * (loss if compat else 1 - loss)


def deposition(pm10: Column | str, velocity: float, seconds: Column | float, tilt: Column | str) -> Column:
    """Dust in g/m2 that settles on a plane; pm10 in g/m3."""
    return col(pm10) * velocity * (seconds if isinstance(seconds, Column) else F.lit(float(seconds))) * F.cos(F.radians(col(tilt)))
