"""Configuration: YAML into dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class Feature:
    """A logical quantity: its column in raw files, its column here, its unit."""

    old_name: str | None
    name: str
    unit: str | None = None


@dataclass(frozen=True)
class WindParams:
    turbines: tuple[str, ...] = ()
    hub_heights: tuple[float, ...] = ()
    rated_kw: tuple[float | None, ...] = ()
    station_height: float = 10.0
    shear: str = "turbulence"
    karman: float = 0.4
    noise: float = 0.0
    annual_degradation: float = 0.0063
    commissioning_date: str | None = None

    def park(self) -> list[tuple[int, str, float, float | None]]:
        """(turbine number from 1, turbine, hub height, curtailed rating in kW)."""
        rated = self.rated_kw or (None,) * len(self.turbines)
        return [(i, *x) for i, x in enumerate(zip(self.turbines, self.hub_heights, rated, strict=True), 1)]


@dataclass(frozen=True)
class PvParams:
    planes: tuple[tuple[float, float], ...] = ()
    dc_rating: float = 10_000.0
    dc_ac_ratio: float = 1.1
    gamma: float = -0.003
    eta_nominal: float = 0.96
    eta_reference: float = 0.9637
    u0: float = 25.0
    u1: float = 6.84
    albedo: float = 0.25
    annual_degradation: float = 0.005
    soiling: dict[str, float] = field(default_factory=dict)


def planes(given: Any) -> tuple[tuple[float, float], ...]:
    """Pairs of tilt and azimuth, also where they are nested one level deeper."""
    if given and given[0] and isinstance(given[0][0], (list, tuple)):
        given = [p for group in given for p in group]
    return tuple((float(a), float(b)) for a, b in given or ())


def load(path: str | Path) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def features(config: dict[str, Any]) -> dict[str, Feature]:
    return {k: Feature(v.get("old_name"), v["name"], v.get("unit")) for k, v in (config.get("features") or {}).items()}


def renames(found: dict[str, Feature]) -> dict[str, str]:
    """Raw column -> column; for DataFrame.withColumnsRenamed, which ignores what a frame lacks."""
    return {f.old_name: f.name for f in found.values() if f.old_name}
