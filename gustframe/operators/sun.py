"""The sun's place in the sky to some ten thousandths of a degree, as steps of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions.nulls import clip, col
from gustframe.functions.times import micros

#: Leading terms of the planetary theory VSOP87 for the earth, (amplitude, phase, rate) of a cosine of millennia since 2000.
#: The longitude in 1e-8 radians; terms below 1e-6 radians (0.00006 degrees) are left out.
LONGITUDE = (
    (3341656, 4.6692568, 6283.07585), (34894, 4.6261, 12566.1517), (3497, 2.7441, 5753.3849), (3418, 2.8289, 3.5231),
    (3136, 3.6277, 77713.7715), (2676, 4.4181, 7860.4194), (2343, 6.1352, 3930.2097), (1324, 0.7425, 11506.7698),
    (1273, 2.0371, 529.691), (1199, 1.1096, 1577.3435), (990, 5.233, 5884.927), (902, 2.045, 26.298), (857, 3.508, 398.149),
    (780, 1.179, 5223.694), (753, 2.533, 5507.553), (505, 4.583, 18849.228), (492, 4.205, 775.523), (357, 2.92, 0.067),
    (317, 5.849, 11790.629), (284, 1.899, 796.298), (271, 0.315, 10977.079), (243, 0.345, 5486.778), (206, 4.806, 2544.314),
    (205, 1.869, 5573.143), (202, 2.458, 6069.777), (156, 0.833, 213.299), (132, 3.411, 2942.463), (126, 1.083, 20.775),
    (115, 0.645, 0.98), (103, 0.636, 4694.003), (102, 0.976, 15720.839), (102, 4.267, 7.114),
)
#: The parts of the longitude that grow with the millennia, and with their square.
LONGITUDE_1 = ((206059, 2.678235, 6283.07585), (4303, 2.6351, 12566.1517), (425, 1.59, 3.523))
LONGITUDE_2 = ((8720, 1.0721, 6283.0758),)
#: The latitude in 1e-8 radians, and the distance in 1e-8 astronomical units.
LATITUDE = ((280, 3.199, 84334.662), (102, 5.422, 5507.553), (80, 3.88, 5223.69))
DISTANCE = ((1670700, 3.0984635, 6283.07585), (13956, 3.05525, 12566.1517))
#: Leading terms of the nutation (IAU 1980) in 0.0001 seconds of arc: multiples of the moon's elongation, the sun's
#: anomaly, the moon's, its argument of latitude and its node; then the longitude's and the obliquity's amplitudes.
NUTATION = (
    (0, 0, 0, 0, 1, -171996, 92025), (-2, 0, 0, 2, 2, -13187, 5736), (0, 0, 0, 2, 2, -2274, 977), (0, 0, 0, 0, 2, 2062, -895),
    (0, 1, 0, 0, 0, 1426, 54), (0, 0, 1, 0, 0, 712, -7), (-2, 1, 0, 2, 2, -517, 224), (0, 0, 0, 2, 1, -386, 200),
    (0, 0, 1, 2, 2, -301, 129), (-2, -1, 0, 2, 2, 217, -95),
)
#: Degrees at noon of the first day of 2000 and a century's growth of the five arguments.
ARGUMENTS = ((297.85036, 445267.11148), (357.52772, 35999.05034), (134.96298, 477198.867398), (93.27191, 483202.017538), (125.04452, -1934.136261))
#: Seconds that terrestrial time is ahead of the earth's rotation, within some seconds since 1995.
DELTA_T = 67.0
#: Degrees below the horizon up to which refraction lifts the sun: its radius and the horizon's own refraction.
RISE = 0.26667 + 0.5667


def _series(terms: tuple, at: Column) -> Column:
    """Sum of cosines. A loop over an array, because the JVM doesn't compile a row's code once it holds all terms side by side."""
    array = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(p)).alias("p"), F.lit(float(w)).alias("w")) for a, p, w in terms])
    return F.aggregate(array, F.lit(0.0), lambda total, t: total + t["a"] * F.cos(t["p"] + t["w"] * at))


def nutation_terms() -> tuple[tuple, tuple]:
    """The nutation in longitude and in obliquity as series of cosines of centuries."""
    at = [tuple(math.radians(sum(k * x[i] for k, x in zip(t, ARGUMENTS))) for i in (0, 1)) for t in NUTATION]
    return tuple((t[5], p - math.pi / 2, w) for t, (p, w) in zip(NUTATION, at, strict=True)), tuple((t[6], p, w) for t, (p, w) in zip(NUTATION, at, strict=True))


def with_sun(df: DataFrame, ts: str, latitude: Column | str, longitude: Column | str, altitude: Column | float = 0.0, pressure: Column | float = 101325.0, temperature: Column | float = 12.0, delta_t: float = DELTA_T, out: str = "sun") -> DataFrame:
    """df with `out`: struct<zenith, azimuth, apparent_zenith, declination, distance>, in degrees (azimuth from north by east) and
    astronomical units.

    Zeniths are those seen from the place on the earth's ellipsoid at its altitude in metres; the apparent one has refraction, for the
    pressure in Pa and the air in Celsius. Good to 0.0005 degrees in the decades around 2000; a wrong delta_t adds 0.00001 degrees for each second.
    Built-in expressions only, a step of columns at a time, so that each angle is computed once a row.
    Null in any input gives null members. A column that is named like `out` is replaced; other columns are kept.
    """
    p = "__sun"
    while any(c.startswith(p) for c in df.columns):
        p += "_"

    def n(name: str) -> Column:
        return F.col(p + name)

    def step(d: DataFrame, **columns: Column) -> DataFrame:
        return d.withColumns({p + k: v for k, v in columns.items()})

    def given(x: Column | float) -> Column:
        return x.cast("double") if isinstance(x, Column) else F.lit(float(x))

    d = step(df, days=micros(ts) / F.lit(86_400e6) + (2440587.5 - 2451545.0), phi=F.radians(col(latitude)), lon=col(longitude).cast("double"), alt=given(altitude), pa=given(pressure), air=given(temperature))
    d = step(d, ce=(n("days") + delta_t / 86400) / 36525)
    d = step(d, me=n("ce") / 10)
    psi, eps = nutation_terms()
    d = step(
        d,
        l0=_series(LONGITUDE, n("me")) + 175347046.0, l1=_series(LONGITUDE_1, n("me")) + 628331966747.0, l2=_series(LONGITUDE_2, n("me")) + 52919.0,
        b=-_series(LATITUDE, n("me")) / 1e8, r=(_series(DISTANCE, n("me")) + 100013989.0) / 1e8,
        psi=F.radians(_series(psi, n("ce")) / 36e6), eps=F.radians(23.4392911 - 0.0130042 * n("ce") + _series(eps, n("ce")) / 36e6),
    )
    # Seen from the earth: nutation, and the light's time.
    d = step(d, lam=(n("l0") + n("me") * (n("l1") + n("me") * n("l2"))) / 1e8 + F.radians(F.lit(180.0)) + n("psi") - F.radians(20.4898 / (3600 * n("r"))))
    d = step(
        d,
        ra=F.atan2(F.sin(n("lam")) * F.cos(n("eps")) - F.tan(n("b")) * F.sin(n("eps")), F.cos(n("lam"))),
        dec=F.asin(F.sin(n("b")) * F.cos(n("eps")) + F.cos(n("b")) * F.sin(n("eps")) * F.sin(n("lam"))),
        nu=F.radians(280.46061837 + 360.98564736629 * n("days") + n("lon")) + n("psi") * F.cos(n("eps")),
        xi=F.sin(F.radians(8.794 / (3600 * n("r")))), u=F.atan(0.99664719 * F.tan(n("phi"))),
    )
    # Seen from the place: parallax.
    d = step(d, h=n("nu") - n("ra"), x=F.cos(n("u")) + n("alt") / 6378140.0 * F.cos(n("phi")), y=0.99664719 * F.sin(n("u")) + n("alt") / 6378140.0 * F.sin(n("phi")))
    d = step(d, da=F.atan2(-n("x") * n("xi") * F.sin(n("h")), F.cos(n("dec")) - n("x") * n("xi") * F.cos(n("h"))))
    d = step(d, dec2=F.atan2((F.sin(n("dec")) - n("y") * n("xi")) * F.cos(n("da")), F.cos(n("dec")) - n("x") * n("xi") * F.cos(n("h"))), h2=n("h") - n("da"))
    d = step(d, e=F.degrees(F.asin(clip(F.sin(n("phi")) * F.sin(n("dec2")) + F.cos(n("phi")) * F.cos(n("dec2")) * F.cos(n("h2")), -1, 1))))
    lifted = n("pa") / 101000.0 * (283.0 / (273.0 + n("air"))) * 1.02 / (60 * F.tan(F.radians(n("e") + 10.3 / (n("e") + 5.11))))
    azimuth = F.degrees(F.atan2(F.sin(n("h2")), F.cos(n("h2")) * F.sin(n("phi")) - F.tan(n("dec2")) * F.cos(n("phi")))) + 180
    seen = F.struct(
        (90 - n("e")).alias("zenith"),
        F.pmod(azimuth, F.lit(360.0)).alias("azimuth"),
        F.when(n("e") >= -RISE, 90 - n("e") - lifted).otherwise(90 - n("e")).alias("apparent_zenith"),
        F.degrees(n("dec2")).alias("declination"),
        n("r").alias("distance"),
    )
    return d.select(*[F.col(c) for c in df.columns if c != out], seen.alias(out))
