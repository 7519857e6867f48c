"""Numeric column expressions: hydraulics, covariances, projections, clipping."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def nan_to_zero(x: Column) -> Column:
    return F.coalesce(nan_to_null(x), F.lit(0.0))


def at_least(x: Column, low) -> Column:
    """greatest(), but null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low) if not isinstance(low, Column) else low))


def masked_above(x: Column, limit: float) -> Column:
    return F.when(x <= limit, x)


def channel(width: Column, depth: Column, slope: Column, roughness: Column, length_km: Column) -> dict[str, Column]:
    """Manning flow in a rectangular channel: velocity, wave celerity, travel time in s and h.
    A slope of zero or less counts as 1e-5."""
    radius = F.try_divide(width * depth, width + 2 * depth)
    velocity = F.try_divide(F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(at_least(slope, 1e-5)), roughness)
    celerity = velocity * (5.0 / 3.0)
    seconds = F.try_divide(1000.0 * length_km, celerity)
    return {"velocity": velocity, "celerity": celerity, "travel_s": seconds, "travel_h": seconds / 3600.0}


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def bernoulli(p: Column, y: Column) -> Column:
    return F.pow(p, y) * F.pow(1.0 - p, 1.0 - y)


def spherical_covariance(h: Column, reach: float) -> Column:
    r = h / reach
    return F.when(h <= reach, 1.0 - 1.5 * r + 0.5 * F.pow(r, F.lit(3.0))).otherwise(0.0)


def exponential_covariance(h: Column, reach: float) -> Column:
    return F.exp(-h / reach)


def variogram(covariance: Column) -> Column:
    return 1.0 - covariance


def elapsed(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%dh:%02dm:%02ds", F.floor(s / 3600).cast("long"), F.pmod(F.floor(s / 60), F.lit(60)).cast("long"), F.pmod(s, F.lit(60)))


# GRS80 and the parallels of the conterminous Albers equal-area projection (EPSG:5070).
_A, _INV_F, _LAT0, _LON0, _SP1, _SP2 = 6378137.0, 298.257222101, 23.0, -96.0, 29.5, 45.5
_E = math.sqrt(2 / _INV_F - 1 / _INV_F**2)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E**2) * (s / (1 - (_E * s) ** 2) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


_N = (_m(math.radians(_SP1)) ** 2 - _m(math.radians(_SP2)) ** 2) / (_q(math.radians(_SP2)) - _q(math.radians(_SP1)))
_C = _m(math.radians(_SP1)) ** 2 + _N * _q(math.radians(_SP1))
_RHO0 = _A * math.sqrt(_C - _N * _q(math.radians(_LAT0))) / _N
ALBERS = {"a": _A, "e": _E, "n": _N, "c": _C, "rho0": _RHO0, "lon0": _LON0}


def albers(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Projected x and y in metres of degrees on GRS80."""
    s = F.sin(F.radians(lat))
    q = (1 - _E**2) * (s / (1 - F.pow(_E * s, F.lit(2.0))) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = _A * F.sqrt(_C - _N * q) / _N
    theta = _N * F.radians(lon - _LON0)
    return rho * F.sin(theta), _RHO0 - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column, steps: int = 6) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of projected metres: Newton steps from the sphere's latitude, a loop within
    one expression. Null where no place projects there."""
    rho, theta = F.sqrt(x * x + (_RHO0 - y) * (_RHO0 - y)), F.atan2(x, _RHO0 - y)
    q = (_C - F.pow(rho * (_N / _A), F.lit(2.0))) / _N
    whole = _q(math.pi / 2)

    def step(at: Column, _: Column) -> Column:
        s = F.sin(at["phi"])
        part = 1 - F.pow(_E * s, F.lit(2.0))
        off = at["q"] / (1 - _E**2) - s / part + F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E)
        return F.struct((at["phi"] + part * part / (2 * F.cos(at["phi"])) * off).alias("phi"), at["q"].alias("q"))

    start = F.struct(F.asin(F.when(F.abs(q) < whole, q / whole)).alias("phi"), q.alias("q"))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["phi"]
    return F.degrees(phi), F.lit(_LON0) + F.degrees(theta / _N)
