"""Positions on a spherical earth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def usable_position(lat: Column, lon: Column) -> Column:
    """True where both coordinates are finite, in range and not both zero; never null."""
    inside = (F.abs(lat) <= 90.0) & (F.abs(lon) <= 180.0) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(inside & ~((lat == 0.0) & (lon == 0.0)), F.lit(False))


def unit_xyz(lat: Column, lon: Column) -> list[Column]:
    """Earth-centred metres (x, y, z), in which straight-line distance orders like arc length."""
    la, lo, r = F.radians(lat), F.radians(lon), F.lit(EARTH_RADIUS_M)
    return [r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la)]
