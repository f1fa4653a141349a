"""Wind speeds at hub height and the power of turbines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustframe.functions.draws import normal
from gustframe.functions.nulls import clip, col, div

KARMAN, SEVENTH, AIR = 0.4, 1 / 7, 1.225


def power_law(v: Column | str, height: Column | float, measured: Column | float, alpha: Column | float) -> Column:
    """v times (height / measured) ** alpha; a negative height means the measured one."""
    h, m = (x if isinstance(x, Column) else F.lit(float(x)) for x in (height, measured))
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return col(v) * F.pow(div(F.when(h < 0, m).otherwise(h), m), a)


def components(v: Column | str, direction: Column | str) -> tuple[Column, Column]:
    """u and v of a speed and the direction it comes from, in degrees."""
    angle = F.radians(270 - col(direction))
    return col(v) * F.cos(angle), col(v) * F.sin(angle)


def speed(u: Column | str, v: Column | str) -> Column:
    return F.hypot(col(u), col(v))


def friction_velocity(u: Column, v: Column, w: Column) -> Column:
    """((w u)^2 + (w v)^2) ^ 1/4."""
    return F.pow(F.pow(w * u, F.lit(2.0)) + F.pow(w * v, F.lit(2.0)), F.lit(0.25))


def shear_turbulence(v: Column | str, sigma: Column | str, direction: Column | str, w: Column | str, karman: float = KARMAN) -> Column:
    """Exponent from turbulence intensity: friction velocity / (karman v).

    The deviation sigma cancels, but must be positive, as v must; calm vertical wind gives 0, not null.
    """
    u, n = components(v, direction)
    return F.when((col(v) > 0) & (col(sigma) > 0), div(friction_velocity(u, n, col(w)), karman * col(v)))


def shear_friction(v: Column | str, sigma: Column | str, friction: Column | str, karman: float = KARMAN) -> Column:
    """The same from a measured friction velocity."""
    return F.when((col(v) > 0) & (col(sigma) > 0), div(friction, karman * col(v)))


def _float_ln(above: Column, below: Column) -> Column:
    """ln(above / below) as floats have it, where Spark's own would be null: infinite at 0, NaN below it."""
    ratio = F.when(below == 0, above * F.pow(below, F.lit(-1.0))).otherwise(F.try_divide(above, below))
    return F.when(ratio > 0, F.ln(ratio)).when(ratio == 0, F.lit(-math.inf)).when(ratio < 0, F.lit(math.nan))


def shear_levels(v1: Column | str, v2: Column | str, h1: float, h2: float, clamp: bool = True, missing: float | None = None, masked: bool = True) -> Column:
    """ln(v2 / v1) / ln(h2 / h1), between 0 and 0.4; `missing` where a speed isn't positive.

    masked False: there it is what floats give, so over calm air it is infinite (0.4 when clamped)."""
    if h1 == h2:
        raise ValueError("the heights must differ")
    ln = F.when((col(v1) > 0) & (col(v2) > 0), F.ln(div(v2, v1))) if masked else _float_ln(col(v2), col(v1))
    a = ln / F.lit(math.log(h2 / h1))
    a = clip(a, 0, 0.4) if clamp else a
    return a if missing is None else F.coalesce(a, F.lit(missing))


def layer_speed(levels: dict[float, str], hub: Column, compat: bool = False, masked: bool = True) -> Column:
    """Speed at hub height from the two levels around it; null outside them.

    compat: the lower level's speed itself, without the power law. masked: as in shear_levels(); without it, air that is calm at the
    lower level only has that speed at this level and NaN above it.
    """
    heights = sorted(levels)
    out = F.lit(None).cast("double")
    for low, high in reversed(list(zip(heights, heights[1:], strict=False))):
        a, b = levels[low], levels[high]
        alpha = shear_levels(a, b, low, high, clamp=False, masked=masked)
        inside = F.col(a) if compat else power_law(a, hub, low, alpha)
        # 1 to the power of anything is 1, but not for the JVM.
        inside = inside if masked else F.when(hub == low, F.col(a)).otherwise(inside)
        out = F.when((hub >= low) & (hub <= high), inside).otherwise(out)
    return out


def ticks(v: Column | str) -> Column:
    """Hundredths of m/s, half to even: the key of curve tables."""
    return F.rint(col(v) * 100).cast("int")


def rotor_area(diameter: Column | str) -> Column:
    return F.lit(math.pi) * F.pow(col(diameter) / 2, F.lit(2.0))


def equivalent_speed(v: Column | str, degradation: Column | float = 1.0) -> Column:
    """Where an aged curve, its speeds stretched by degradation ** -1/3, meets the new one: v times degradation ** 1/3."""
    d = degradation if isinstance(degradation, Column) else F.lit(float(degradation))
    return col(v) * F.pow(d, F.lit(1 / 3))


def power_coefficient(power: Column | str, v: Column | str, diameter: Column | str) -> Column:
    """Share of the wind's power at standard density, from 0 to 1; 0 in calm."""
    v = col(v)
    cp = div(power, 0.5 * AIR * rotor_area(diameter) * F.pow(v, F.lit(3.0)))
    return F.when(v == 0, 0.0).otherwise(clip(cp, 0, 1))


def turbine_power(v: Column | str, cp: Column | str, rho: Column | str, diameter: Column | str, cut_in: Column | str, cut_out: Column | str, rated: Column | str) -> Column:
    """W: 0 below cut-in, above cut-out and without a speed; at most the rating."""
    v = col(v)
    full = 0.5 * col(rho) * rotor_area(diameter) * col(cp) * F.pow(v, F.lit(3.0))
    inside = (v >= col(cut_in)) & (v <= col(cut_out))
    return F.coalesce(F.when(inside, F.least(full, col(rated))), F.lit(0.0))


def noisy(power: Column | str, rated: Column | str, noise: float, seed: int, *key: Column | str) -> Column:
    """Times a normal factor around 1 with deviation `noise`, between 0 and the rating; the draw depends on seed and key only."""
    if noise == 0:
        return col(power)
    return F.least(F.greatest(col(power) * (1 + noise * normal(seed, *key)), F.lit(0.0)), col(rated))


def rating(curtailed_kw: Column | str, curve_max_w: Column | str) -> Column:
    return F.coalesce(col(curtailed_kw) * 1000, col(curve_max_w))


def park_coefficient(power_kw: Column | str, rho: Column | str, area: Column | str, v: Column | str) -> Column:
    return div(col(power_kw) * 1000, 0.5 * col(rho) * col(area) * F.pow(col(v), F.lit(3.0)))
