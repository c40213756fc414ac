"""Transverse Mercator projections of Korea, tile envelopes and the overlap of boxes, as columns."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Grid(NamedTuple):
    """A transverse Mercator grid: origin in degrees, scale on its meridian, false origin in metres."""

    lat0: float
    lon0: float
    scale: float
    east: float
    north: float


#: The ellipsoid of 1980 and the two national grids.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257222101
GRIDS = {5179: Grid(38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0), 5186: Grid(38.0, 127.0, 1.0, 200_000.0, 600_000.0)}

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Series of the third flattening up to its fourth power (forward, back, latitude).
ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4, _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)


def _meridian(grid: Grid) -> float:
    """The grid's origin as an angle along the meridian."""
    sine = math.sin(math.radians(grid.lat0))
    chi = math.atan(math.sinh(math.atanh(sine) - _E * math.atanh(_E * sine)))
    return chi + sum(a * math.sin(2 * j * chi) for j, a in enumerate(ALPHA, 1))


def to_grid(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    """Metres east and north on the grid of the code; null where a coordinate is, or is out of range."""
    grid = GRIDS[code]
    valid = lon.between(-180, 180) & lat.between(-89.9, 89.9)
    sine, d = F.sin(F.radians(lat)), F.radians(lon - grid.lon0)
    t = F.sinh(F.atanh(sine) - _E * F.atanh(_E * sine))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    size = grid.scale * _A
    return F.when(valid, grid.east + size * x), F.when(valid, grid.north + size * (y - _meridian(grid)))


def from_grid(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of metres on the grid of the code."""
    grid = GRIDS[code]
    size = grid.scale * _A
    xi, eta = (y - grid.north) / size + _meridian(grid), (x - grid.east) / size
    a, b = xi, eta
    for j, c in enumerate(BETA, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(DELTA, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return grid.lon0 + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


def tile_envelope(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Whether the address exists, and west, south, east and north of its tile in degrees (else null)."""
    side = F.pow(F.lit(2.0), z)
    valid = z.between(0, 22) & (x >= 0) & (y >= 0) & (x < side) & (y < side)

    def lon(n: Column) -> Column:
        return F.when(valid, n / side * 360 - 180)

    def lat(n: Column) -> Column:
        return F.when(valid, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * n / side)))))

    return valid, lon(x), lat(y + 1), lon(x + 1), lat(y)


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Shared area over joint area of two boxes (west, south, east, north); 0 if they only touch."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shared = F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0.0))
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return F.when(joint > 0, shared / joint).otherwise(F.lit(0.0))
