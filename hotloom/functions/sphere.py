"""Great-circle geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees on a sphere of radius ``EARTH_M``."""
    a = F.radians(lat1)
    b = F.radians(lat2)
    s = F.sin((b - a) / 2)
    t = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = s * s + F.cos(a) * F.cos(b) * t * t
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


#: A cell's sides in radii: twice as large cells hold more candidates, but a point looks into fewer of them.
CELL_RADII = 2


def degrees_north(radius_m: float) -> float:
    """Degrees of latitude that points at most ``radius_m`` apart can differ by."""
    return math.degrees(radius_m / EARTH_M) * (1 + 1e-9)


def band_height(radius_m: float) -> float:
    return CELL_RADII * degrees_north(radius_m)


def reach(band: Column, radius_m: float) -> Column:
    """Degrees of longitude that points at most ``radius_m`` apart can differ by, one of them in the latitude band and
    the other there or in a band beside it; 180 where it may be any."""
    edge = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(band_height(radius_m)), F.lit(90.0))
    ratio = F.lit(math.sin(radius_m / EARTH_M / 2) * (1 + 1e-9)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    return F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 2 * (1 + 1e-9))


def cells_round(band: Column, radius_m: float) -> Column:
    """How many cells, each at least CELL_RADII reaches wide, the band is divided into."""
    return F.greatest(F.floor(F.lit(360.0 / CELL_RADII) / reach(band, radius_m)), F.lit(1)).cast("long")
