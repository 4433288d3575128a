"""Column helpers for distances, slopes and map tiles. All measures are SI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
METRES_PER_FOOT = 0.3048
MOVING_MPS = 0.5 / 3.6
PAUSE_MIN_S = 10
TILE_ZOOM, TILE_PIXELS, MAX_MERCATOR_LAT = 12, 512, 85.0511287


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return 2 * EARTH_RADIUS_M * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))


def segment_3d(h: Column, dz: Column) -> Column:
    return F.sqrt(h * h + dz * dz)


def minetti_factor(grade: Column) -> Column:
    """Cost of running at a slope against running level; slopes are held within 45 %."""
    g = F.greatest(F.lit(-0.45), F.least(F.lit(0.45), grade))
    cost = F.lit(3.6) + g * (F.lit(19.5) + g * (F.lit(46.3) + g * (F.lit(-43.3) + g * (F.lit(-30.4) + g * F.lit(155.4)))))
    return F.when(grade.isNotNull(), cost / 3.6)


def speed_to_pace(speed: Column) -> Column:
    """Seconds per kilometre; null without movement."""
    return F.when(speed > 0, F.lit(1000.0) / speed)


def speed_implausible(speed: Column, dd: Column, dt: Column) -> Column:
    """Whether a recorded speed is over 1.5 times what the positions support."""
    return F.coalesce((dt > 0) & (dd >= 0) & (speed > 1.5 * F.try_divide(dd, dt)), F.lit(False))


def segment_type(gain: Column, loss: Column, net: Column) -> Column:
    """flat, climb, descent or mixed; null without elevation."""
    relief = gain + loss
    kind = (
        F.when(relief < 5, "flat")
        .when((net > 0) & (gain >= 0.65 * relief), "climb")
        .when((net < 0) & (loss >= 0.65 * relief), "descent")
        .when((net > 0) & (gain > 1.4 * loss), "climb")
        .when((net < 0) & (loss > 1.4 * gain), "descent")
        .otherwise("mixed")
    )
    return F.when(gain.isNotNull() & loss.isNotNull() & net.isNotNull(), kind)


def tile_x(lon: Column) -> Column:
    """Fractional tile column at zoom 12; longitudes wrap."""
    return (F.pmod(lon + 180, F.lit(360.0)) / 360) * (1 << TILE_ZOOM)


def tile_y(lat: Column) -> Column:
    """Fractional tile row at zoom 12; null beyond the Mercator limit."""
    r = F.radians(lat)
    y = (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * (1 << TILE_ZOOM)
    return F.when(F.abs(lat) <= MAX_MERCATOR_LAT, y)


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Elevation of a coded pixel; null outside -12000..9000."""
    e = r * 256 + g + b / 256 - 32768
    return F.when((e >= -12000) & (e <= 9000), e)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Between a and b; a null end gives the other one."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * t)
