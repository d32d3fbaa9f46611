"""Points: Morton codes, distance, bounding boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = {"Kilometers": 6371.0087714, "Miles": 3958.761315801475}
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(x: int) -> int:
    x &= 0xFFFFFFFF
    for s, m in _SPREAD:
        x = (x | x << s) & m
    return x


def _gather(x: int) -> int:
    x &= 0x5555555555555555
    for s, m in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | x >> s) & m
    return x - (1 << 32) if x >> 31 else x


def encode_morton(lat: float, lon: float) -> int:
    """Unsigned 64-bit code of a point in units of 1e-7 degrees: latitude in the even bits, longitude in the odd."""
    return _spread(math.trunc(lat * 1e7)) | _spread(math.trunc(lon * 1e7)) << 1


def decode_morton(code: int) -> tuple[float, float]:
    return _gather(code) / 1e7, _gather(code >> 1) / 1e7


def _spread_column(c: Column) -> Column:
    x = F.floor(F.abs(c) * 1e7).cast("bigint") * F.signum(c).cast("bigint")
    x = x.bitwiseAND(0xFFFFFFFF)
    for s, m in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, s)).bitwiseAND(m)
    return x


def morton(lat: Column, lon: Column) -> Column:
    """The code as a signed bigint (the same 64 bits)."""
    return _spread_column(lat).bitwiseOR(F.shiftleft(_spread_column(lon), 1))


def distance(lat: Column, lon: Column, base: tuple[float, float], unit: str = "Kilometers") -> Column:
    """Equirectangular distance from a base point."""
    b_lat, b_lon = (F.lit(float(x)) for x in base)
    x = F.radians(lon - b_lon) * F.cos(F.radians((lat + b_lat) / 2))
    y = F.radians(lat - b_lat)
    return F.lit(RADIUS[unit]) * F.sqrt(x * x + y * y)


def distance_sql(lat: str, lon: str, base: tuple[float, float], unit: str = "Kilometers") -> str:
    """The same in SQL, for either engine."""
    x = f"(radians({lon} - ({base[1]})) * cos(radians(({lat} + ({base[0]})) / 2.0)))"
    y = f"radians({lat} - ({base[0]}))"
    return f"({RADIUS[unit]} * sqrt({x} * {x} + {y} * {y}))"


def box(base: tuple[float, float], radius: float, unit: str = "Kilometers") -> tuple[float, float, float, float]:
    """Least and largest latitude and longitude within a radius; plain comparisons that reach the scan."""
    d = math.degrees(radius / RADIUS[unit])
    far = min(89.999, abs(base[0]) + d)
    e = d / max(1e-9, math.cos(math.radians((abs(base[0]) + far) / 2)))
    return base[0] - d, base[0] + d, base[1] - e, base[1] + e


def within(lat: Column, lon: Column, base: tuple[float, float], low: float, high: float, unit: str = "Kilometers") -> Column:
    """low <= distance < high, behind a bounding box."""
    a, b, c, d = box(base, high, unit)
    far = distance(lat, lon, base, unit)
    return lat.between(a, b) & lon.between(c, d) & (far >= low) & (far < high)
