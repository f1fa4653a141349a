"""Air: temperature, pressure, humidity and density as columns. Temperatures in degrees Celsius unless a name says kelvin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustframe.functions.nulls import col, div

#: Kelvin at 0 degrees, lapse rate K/m, gravity, gas constant, molar mass of air, gas constants of dry air and vapour.
KELVIN, LAPSE, GRAVITY, GAS, MOLAR = 273.15, 0.0065, 9.81, 8.31451, 0.028949
R_DRY, R_VAPOUR = 287.05, 461.5
EXPONENT = MOLAR * GRAVITY / (GAS * LAPSE)


def temperature_at(t: Column | str, height: Column | float, measured: float = 2.0) -> Column:
    """Cooler by the lapse rate per metre above the height of measurement; in the unit of t."""
    return col(t) - LAPSE * (height - F.lit(measured))


def _ratio(t_kelvin: Column, up: Column) -> Column:
    return 1 - div(LAPSE * up, t_kelvin)


def pressure_at(p: Column | str, t: Column | str, height: Column | float, measured: float = 2.0) -> Column:
    """Barometric formula; p in any unit."""
    return col(p) * F.pow(_ratio(col(t) + KELVIN, height - F.lit(measured)), F.lit(EXPONENT))


def density_at(rho: Column | str, t: Column | str, height: Column | float, measured: float = 2.0) -> Column:
    return col(rho) * F.pow(_ratio(col(t) + KELVIN, height - F.lit(measured)), F.lit(EXPONENT - 1))


def vapour_huang(t: Column | str) -> Column:
    """Saturation vapour pressure in Pa over water and ice (Huang 2018)."""
    x = col(t)
    water = F.exp(34.494 - div(F.lit(4924.99), x + 237.1)) / F.pow(x + 105, F.lit(1.57))
    ice = F.exp(43.494 - div(F.lit(6545.8), x + 278)) / F.pow(x + 868, F.lit(2.0))
    return F.when(x > 0, water).otherwise(ice)


def vapour_magnus(t: Column | str) -> Column:
    """Saturation vapour pressure in Pa, improved Magnus form."""
    x = col(t)
    return F.when(x > 0, 610.94 * F.exp(div(17.625 * x, x + 243.04))).otherwise(611.21 * F.exp(div(22.587 * x, x + 273.86)))


VAPOUR = {"huang": vapour_huang, "improved_magnus": vapour_magnus}


def vapour(t: Column | str, model: str = "huang") -> Column:
    if model not in VAPOUR:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(VAPOUR)}")
    return VAPOUR[model](t)


def humidity_scale(rh: Column | str, over) -> Column:
    """Relative humidity as a fraction: series whose largest value exceeds 1 are in percent. over: a window of the series."""
    return col(rh) / F.when(F.max(col(rh)).over(over) > 1, F.lit(100.0)).otherwise(F.lit(1.0))


def moist_density(p_pa: Column | str, t: Column | str, humidity: Column | str, vapour_pa: Column | str) -> Column:
    """kg/m3 of dry air and vapour together; humidity as a fraction."""
    kelvin, wet = col(t) + KELVIN, col(humidity) * col(vapour_pa)
    return div(col(p_pa) - wet, R_DRY * kelvin) + div(wet, R_VAPOUR * kelvin)


def relative_humidity(t: Column | str, dew_point: Column | str, model: str = "huang") -> Column:
    """Fraction, from the dew point."""
    return div(vapour(dew_point, model), vapour(t, model))


def standard_pressure(height: Column | str) -> Column:
    """hPa of the standard atmosphere at a height in metres."""
    return 1013.25 * F.pow(1 - LAPSE / 288.0 * col(height), F.lit(9.80665 / (287.04749 * LAPSE)))


def celsius(t: Column | str, over) -> Column:
    """Kelvin becomes Celsius for series whose mean isn't below 100."""
    return F.when(F.avg(col(t)).over(over) < 100, col(t)).otherwise(col(t) - KELVIN)


def pascal(p: Column | str, over) -> Column:
    """hPa becomes Pa for series whose mean is below 5000."""
    return F.when(F.avg(col(p)).over(over) < 5e3, col(p) * 100).otherwise(col(p))
