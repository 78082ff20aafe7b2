"""Distances, bearings and projections of longitude and latitude columns (degrees)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import col, if_else

# Sphere radius, and the Lambert conformal conic of metropolitan France.
EARTH_RADIUS_KM = 6371.01
LAMBERT_FRANCE = {"lat0": 46.5, "lon0": 3.0, "lat1": 44.0, "lat2": 49.0, "x0": 700000.0, "y0": 6600000.0}
GRS80_AXIS = 6378137.0
GRS80_FLATTENING = 1 / 298.257222101
# Corners of the report maps (longitude, latitude).
REPORT_BOX = ((-10.0, 35.0), (18.0, 55.0))


def bearing(lon1, lon2, lat1, lat2) -> Column:
    """Initial great-circle bearing in degrees, -180 to 180."""
    d = F.radians(col(lon2) - col(lon1))
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    return F.degrees(F.atan2(F.cos(b) * F.sin(d), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def planar_bearing(lon1, lon2, lat1, lat2) -> Column:
    return F.degrees(F.atan2(col(lon2) - col(lon1), col(lat2) - col(lat1)))


def distance_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance on the sphere."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2) - col(lon1))
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def unit_vector(lon, lat) -> tuple[Column, Column, Column]:
    lo, la = F.radians(col(lon)), F.radians(col(lat))
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def segment_distance_km(lon, lat, x1, y1, x2, y2) -> Column:
    """Distance from a point to a great-circle segment; a segment of length zero is a point."""
    p, a, b = unit_vector(lon, lat), unit_vector(x1, y1), unit_vector(x2, y2)
    n = _cross(a, b)
    length = F.sqrt(_dot(n, n))
    beside = (_dot(_cross(n, a), p) > 0) & (_dot(_cross(b, n), p) > 0)
    across = F.lit(EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.abs(_dot(n, p)) / length))
    ends = F.least(distance_km(lon, lat, x1, y1), distance_km(lon, lat, x2, y2))
    return F.when((length > 1e-15) & beside, across).otherwise(ends)


def box_distance_floor_km(lon, lat, xa, ya, xb, yb) -> Column:
    """A distance that no point of the box can undercut."""
    lon, lat = col(lon), col(lat)
    dlat = F.greatest(col(ya) - lat, lat - col(yb), F.lit(0.0))
    near = F.greatest(col(xa) - lon, lon - col(xb), F.lit(0.0))
    around = 360 - F.greatest(F.abs(col(xa) - lon), F.abs(col(xb) - lon))  # across the date line
    dlon = F.least(near, F.greatest(around, F.lit(0.0)))
    to_meridian = F.when(
        dlon < 90, F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat)) * F.sin(F.radians(dlon))))
    ).otherwise(F.radians(90 - F.abs(lat)))
    return F.lit(EARTH_RADIUS_KM) * F.greatest(F.radians(dlat), to_meridian)


def crossing(px, py, x1, y1, x2, y2) -> Column:
    """1 when a ray from the point to the right crosses the edge; edges own their lower end."""
    px, py, x1, y1, x2, y2 = (col(c) for c in (px, py, x1, y1, x2, y2))
    spans = (y1 > py) != (y2 > py)
    at = (x2 - x1) * (py - y1) / F.when(y2 != y1, y2 - y1) + x1
    return F.when(spans & (px < at), 1).otherwise(0)


def planar_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a straight segment in projected units."""
    px, py, x1, y1, x2, y2 = (col(c) for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def segments_meet(a: tuple, b: tuple) -> Column:
    """True when two straight segments (x1, y1, x2, y2) properly cross."""
    ax1, ay1, ax2, ay2 = (col(c) for c in a)
    bx1, by1, bx2, by2 = (col(c) for c in b)

    def side(ox, oy, px, py, qx, qy):
        return F.signum((px - ox) * (qy - oy) - (py - oy) * (qx - ox))

    return (side(ax1, ay1, ax2, ay2, bx1, by1) * side(ax1, ay1, ax2, ay2, bx2, by2) < 0) & (
        side(bx1, by1, bx2, by2, ax1, ay1) * side(bx1, by1, bx2, by2, ax2, ay2) < 0)


def planar_edge_distance(a: tuple, b: tuple) -> Column:
    """Distance between two straight segments; 0 where they cross or touch."""
    near = F.least(
        planar_segment_distance(a[0], a[1], *b), planar_segment_distance(a[2], a[3], *b),
        planar_segment_distance(b[0], b[1], *a), planar_segment_distance(b[2], b[3], *a))
    return F.when(segments_meet(a, b), F.lit(0.0)).otherwise(near)


def _lambert_constants(p: dict) -> tuple[float, float, float, float, float]:
    """Cone constant, scale, eccentricity, central meridian and y of the pole of the cone."""
    e = math.sqrt(2 * GRS80_FLATTENING - GRS80_FLATTENING**2)

    def iso(lat):
        s = e * math.sin(lat)
        return math.log(math.tan(math.pi / 4 + lat / 2) * ((1 - s) / (1 + s)) ** (e / 2))

    def normal(lat):
        return GRS80_AXIS / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    lat0, lat1, lat2 = (math.radians(p[k]) for k in ("lat0", "lat1", "lat2"))
    n = math.log(normal(lat2) * math.cos(lat2) / (normal(lat1) * math.cos(lat1))) / (iso(lat1) - iso(lat2))
    c = normal(lat1) * math.cos(lat1) / n * math.exp(n * iso(lat1))
    return n, c, e, math.radians(p["lon0"]), p["y0"] + c * math.exp(-n * iso(lat0))


def lambert_constants(params: dict | None = None) -> tuple[float, float, float, float, float]:
    return _lambert_constants(params or LAMBERT_FRANCE)


def to_lambert(lon, lat, params: dict | None = None) -> tuple[Column, Column]:
    """Projected x and y in metres."""
    p = params or LAMBERT_FRANCE
    n, c, e, lon0, ys = _lambert_constants(p)
    lo, la = F.radians(col(lon)), F.radians(col(lat))
    s = F.lit(e) * F.sin(la)
    iso = F.log(F.tan(F.lit(math.pi / 4) + la / 2) * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    r = F.lit(c) * F.exp(F.lit(-n) * iso)
    g = F.lit(n) * (lo - F.lit(lon0))
    return F.lit(p["x0"]) + r * F.sin(g), F.lit(ys) - r * F.cos(g)


def full_turn_radians(deg) -> Column:
    """-180..180 degrees to 0..2 pi."""
    c = col(deg)
    return F.radians(if_else(c < 0, c + 360, c))


def half_turn_degrees(rad) -> Column:
    """0..2 pi to -180..180 degrees."""
    c = col(rad)
    return F.degrees(if_else(c > math.pi, c - 2 * math.pi, c))


def east_share(deg) -> Column:
    return F.sin(F.radians(col(deg)))


def north_share(deg) -> Column:
    return F.cos(F.radians(col(deg)))
