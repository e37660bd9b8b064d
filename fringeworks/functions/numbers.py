"""Guarded numeric expressions: NaN and division behave as in floating-point array code.

Spark orders NaN above every number and raises on division by zero; these
expressions make comparisons with NaN false and zero denominators harmless.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT = 299_792_458.0  # m/s
EARTH_TURN = 7.2921150e-5  # rad/s
#: Seconds from 1858-11-17 (modified Julian day 0) to 1970-01-01.
EPOCH_S = 3_506_716_800


def amplitude(re_: Column, im: Column) -> Column:
    return F.hypot(re_, im)


def above(x: Column, limit) -> Column:
    return (x > F.lit(limit)) & ~F.isnan(x)


def at_least(x: Column, limit) -> Column:
    return (x >= F.lit(limit)) & ~F.isnan(x)


def squared_uv() -> Column:
    return F.col("u") * F.col("u") + F.col("v") * F.col("v")


def uv_distance() -> Column:
    return F.sqrt(squared_uv())


def inverse_square(sigma: Column) -> Column:
    return F.when(sigma == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / (sigma * sigma))


def or_one(total: Column) -> Column:
    """A denominator: 1 where the total is 0."""
    return F.when(total == 0, F.lit(1.0)).otherwise(total)


def timestamp_of(seconds: Column) -> Column:
    """A timestamp from seconds since 1858-11-17 UTC."""
    return F.timestamp_micros(F.round((seconds - F.lit(float(EPOCH_S))) * 1e6).cast("bigint"))


_UNITS = {"rad": 1.0, "deg": math.pi / 180, "arcmin": math.pi / 10_800, "arcsec": math.pi / 648_000}


def angle(text: str) -> float:
    """Radians of '1.0 deg', '30 arcmin', '5 arcsec' or '0.1 rad'; a bare number is in degrees."""
    m = re.fullmatch(r"\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*([A-Za-z]*)\s*", text)
    unit = (m[2].lower() or "deg") if m else ""
    for name in (unit, unit.removesuffix("s")):
        if name in _UNITS:
            return float(m[1]) * _UNITS[name]
    raise ValueError(f"not an angle: {text!r}")


def longest_integration(uv_max: float, frequency: float, offset: float, loss: float) -> float:
    """Seconds that may be averaged before the turning Earth costs ``loss`` of the amplitude at ``offset`` radians."""
    if min(uv_max, frequency, offset) <= 0:
        return math.inf
    return LIGHT * math.sqrt(6 * loss) / (math.pi * EARTH_TURN * uv_max * frequency * offset)


def image_size(uv_max: float, frequency: float, fov: float, oversampling: float) -> tuple[float, int] | None:
    """Resolution in radians and an even number of pixels; None where there is no resolution."""
    if not frequency or not uv_max:
        return None
    resolution = LIGHT / (frequency * uv_max)
    return resolution, (int(oversampling * fov / resolution) + 1) // 2 * 2
