"""Spatial scalar functions as Columns, so that they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius (m) of great-circle lengths, and metres per degree of the local plane.
EARTH_RADIUS, PLANE = 6_371_000.0, 111_320.0
#: Emission sigma's floor (m), transition beta (m), search radius from and to (m).
SIGMA, BETA, RADIUS, RADIUS_MOST = 4.07, 1.0, 25.0, 150.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, from 0 up to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def _plane(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return (lon - lon0) * F.lit(PLANE) * F.cos(F.radians(lat0)), (lat - lat0) * F.lit(PLANE)


def segment_fraction(lat: Column, lon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Where on the segment a-b the nearest point lies, from 0 to 1; 0 on a segment without length."""
    px, py = _plane(lat, lon, alat, alon)
    bx, by = _plane(blat, blon, alat, alon)
    square = bx * bx + by * by
    return F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / F.when(square != 0, square))))


def segment_distance(lat: Column, lon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Metres in the local plane from a point to the segment."""
    px, py = _plane(lat, lon, alat, alon)
    bx, by = _plane(blat, blon, alat, alon)
    t = segment_fraction(lat, lon, alat, alon, blat, blon)
    return F.sqrt(F.pow(px - t * bx, F.lit(2.0)) + F.pow(py - t * by, F.lit(2.0)))


def segment_length(alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    x, y = _plane(blat, blon, alat, alon)
    return F.sqrt(x * x + y * y)


def tile_x(lon: Column, zoom: int = 12) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.lit(float(1 << zoom)))


def tile_y(lat: Column, zoom: int = 12) -> Column:
    r = F.radians(lat)
    return F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.lit(3.141592653589793)) / 2.0 * F.lit(float(1 << zoom)))


def emission(distance: Column, accuracy: Column) -> Column:
    """Log probability of a fix at a distance from its road; sigma is half the accuracy, SIGMA at least."""
    sigma = F.when(accuracy.isNull() | F.isnan(accuracy) | (accuracy <= 0), F.lit(SIGMA)).otherwise(F.greatest(F.lit(SIGMA), accuracy / 2))
    return -F.lit(0.5) * F.pow(distance / sigma, F.lit(2.0)) - F.log(sigma * F.lit(2.5066282746310002))


def search_radius(accuracy: Column) -> Column:
    ok = accuracy.isNotNull() & ~F.isnan(accuracy) & (accuracy > 0)
    return F.when(ok, F.least(F.lit(RADIUS_MOST), F.greatest(F.lit(RADIUS), F.lit(RADIUS) + accuracy / 2))).otherwise(F.lit(RADIUS))


def transition(route: Column, straight: Column, beta: float = BETA) -> Column:
    """Log probability of a step whose route and straight line differ; minus infinity for a scale that isn't positive."""
    if beta <= 0:
        return F.lit(-math.inf)
    return F.lit(-math.log(beta)) - F.abs(route - straight) / F.lit(beta)


def tile_box(x: Column, y: Column, zoom: int = 12) -> dict[str, Column]:
    """A tile's box: min_lat, min_lon, max_lat, max_lon."""
    n = float(1 << zoom)
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - v * 2 / F.lit(n)))))
    lon = lambda v: v / F.lit(n) * 360.0 - 180.0
    return {"min_lat": lat(y + 1), "min_lon": lon(x), "max_lat": lat(y), "max_lon": lon(x + 1)}


def box_tiles(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, zoom: int = 12) -> Column:
    """All tiles that a box touches, as an array of {x, y}, x before y. Tile rows grow southwards."""
    xs = F.sequence(tile_x(min_lon, zoom), tile_x(max_lon, zoom))
    ys = F.sequence(tile_y(max_lat, zoom), tile_y(min_lat, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def plane_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres in the plane at the middle latitude."""
    x = (lon2 - lon1) * F.lit(PLANE) * F.cos(F.radians((lat1 + lat2) / 2))
    y = (lat2 - lat1) * F.lit(PLANE)
    return F.sqrt(x * x + y * y)


def padded(low: Column, high: Column) -> tuple[Column, Column]:
    """A span of less than 1e-4 degrees, widened by 5e-4 on both sides."""
    thin = high - low < 1e-4
    return F.when(thin, low - 5e-4).otherwise(low), F.when(thin, high + 5e-4).otherwise(high)


def pixel(lat: Column, lon: Column, box: dict[str, Column], width: float, height: float, pad: float) -> tuple[Column, Column]:
    """Where in an image a place is drawn, whose box fills the image but for a pad; null outside of the box and for an empty one."""
    fx = F.try_divide(lon - box["min_lon"], box["max_lon"] - box["min_lon"])
    fy = F.lit(1.0) - F.try_divide(lat - box["min_lat"], box["max_lat"] - box["min_lat"])
    sound = (box["max_lat"] > box["min_lat"]) & (box["max_lon"] > box["min_lon"]) & F.lit(width > 2 * pad and height > 2 * pad) & fx.between(0, 1) & fy.between(0, 1)
    return F.when(sound, F.lit(pad) + fx * (width - 2 * pad)), F.when(sound, F.lit(pad) + fy * (height - 2 * pad))


#: Half axis (m) and flattening of the WGS 84 ellipsoid.
HALF_AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563


def ellipsoid(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Geodesic metres on the ellipsoid by Lambert's formula: off by about ten metres over thousands of kilometres, next to nothing over a road; 0 for equal places."""
    reduced = lambda c: F.atan((1 - FLATTENING) * F.tan(F.radians(c)))
    b, c = reduced(lat), reduced(lat2)
    half = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    h = half(c - b) + F.cos(b) * F.cos(c) * half(F.radians(lon2) - F.radians(lon))
    s = 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    p, q = (b + c) / 2, (c - b) / 2
    square = lambda x: x * x
    x = (s - F.sin(s)) * square(F.sin(p)) * square(F.cos(q)) / square(F.cos(s / 2))
    y = (s + F.sin(s)) * square(F.cos(p)) * F.try_divide(square(F.sin(q)), square(F.sin(s / 2)))
    return F.when(h == 0, F.lit(0.0)).otherwise(F.lit(HALF_AXIS) * (s - FLATTENING / 2 * (x + y)))
