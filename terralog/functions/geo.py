"""Geodesy, datum and tiling formulas as column expressions (no Python in the row path)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean sphere radius, and metres per degree of latitude on it.
EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0

# Spherical web mercator.
MERCATOR_RADIUS_M = 6378137.0

# Coordinate system labels and WKIDs that are accepted.
WGS84_LABELS = ("EPSG:4326", "EPSG:4490", "CRS84", "OGC:CRS84")
MERCATOR_WKIDS = (3857, 102100, 102113)
GAUSS_KRUGER_WKIDS = range(4534, 4555)      # 3-degree zones, central meridian 75E .. 135E
GAUSS_KRUGER_FALSE_EASTING = 500000.0
CGCS2000_A = 6378137.0
CGCS2000_F = 1.0 / 298.257222101

# The GCJ-02 offset model. Polynomial terms are (1, x, y, squared, x*y, sqrt|x|);
# harmonics are (argument, wavelength divisor, amplitude), summed and scaled by 2/3.
GCJ_A = 6378245.0
GCJ_EE = 0.00669342162296594323
GCJ_LON_RANGE = (72.004, 137.8347)
GCJ_LAT_RANGE = (0.8293, 55.8271)
GCJ_ORIGIN = (105.0, 35.0)
GCJ_LAT_POLY = (-100.0, 2.0, 3.0, 0.2, 0.1, 0.2)
GCJ_LON_POLY = (300.0, 1.0, 2.0, 0.1, 0.1, 0.1)
GCJ_SHARED_HARMONICS = (("x", 1 / 6.0, 20.0), ("x", 1 / 2.0, 20.0))
GCJ_LAT_HARMONICS = (("y", 1.0, 20.0), ("y", 3.0, 40.0), ("y", 12.0, 160.0), ("y", 30.0, 320.0))
GCJ_LON_HARMONICS = (("x", 1.0, 20.0), ("x", 3.0, 40.0), ("x", 12.0, 150.0), ("x", 30.0, 300.0))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def micro(metres: Column) -> Column:
    """Metres from zero to 9e12, rounded half up to six places in binary arithmetic; the decimal rounding of ``F.round`` costs more than the distance itself."""
    return F.floor(metres * 1e6 + 0.5) / 1e6


def _gcj_offset(lon: Column, lat: Column) -> tuple[Column, Column]:
    axes = {"x": lon - GCJ_ORIGIN[0], "y": lat - GCJ_ORIGIN[1]}
    x, y = axes["x"], axes["y"]

    def surface(poly: tuple, squared: Column, waves: tuple) -> Column:
        terms = (F.lit(1.0), x, y, squared, x * y, F.sqrt(F.abs(x)))
        total = sum((t * c for t, c in zip(terms[1:], poly[1:])), F.lit(poly[0]))
        wave = sum((F.sin(axes[a] * math.pi / div) * amp for a, div, amp in waves), F.lit(0.0))
        return total + wave * 2.0 / 3.0

    north = surface(GCJ_LAT_POLY, y * y, GCJ_SHARED_HARMONICS + GCJ_LAT_HARMONICS)
    east = surface(GCJ_LON_POLY, x * x, GCJ_SHARED_HARMONICS + GCJ_LON_HARMONICS)
    phi = F.radians(lat)
    flat = 1.0 - GCJ_EE * F.pow(F.sin(phi), 2)
    meridian = GCJ_A * (1 - GCJ_EE) / (flat * F.sqrt(flat))
    parallel = GCJ_A / F.sqrt(flat) * F.cos(phi)
    return F.degrees(east / parallel), F.degrees(north / meridian)


def in_gcj_region(lon: Column, lat: Column) -> Column:
    return lon.between(*GCJ_LON_RANGE) & lat.between(*GCJ_LAT_RANGE)


def wgs84_to_gcj02(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Offset datum inside the region; other points pass through."""
    dlon, dlat = _gcj_offset(lon, lat)
    inside = in_gcj_region(lon, lat)
    return F.when(inside, lon + dlon).otherwise(lon), F.when(inside, lat + dlat).otherwise(lat)


def gcj02_to_wgs84(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Approximate inverse: the forward offset at the shifted point, subtracted."""
    dlon, dlat = _gcj_offset(lon, lat)
    inside = in_gcj_region(lon, lat)
    return F.when(inside, lon - dlon).otherwise(lon), F.when(inside, lat - dlat).otherwise(lat)


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    return (F.degrees(x / MERCATOR_RADIUS_M),
            F.degrees(F.lit(math.pi / 2) - 2 * F.atan(F.exp(-y / MERCATOR_RADIUS_M))))


def wgs84_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return (F.radians(lon) * MERCATOR_RADIUS_M,
            F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS_M)


def gauss_kruger_to_wgs84(x: Column, y: Column, wkid: Column) -> tuple[Column, Column]:
    """Inverse transverse Mercator, Krueger series to n^4, for the 3-degree zones."""
    n = CGCS2000_F / (2 - CGCS2000_F)
    rect = CGCS2000_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
             7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
             56 * n**3 / 15 - 136 * n**4 / 35,
             4279 * n**4 / 630)
    xi, eta = y / rect, (x - GAUSS_KRUGER_FALSE_EASTING) / rect
    xi_p, eta_p = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_p = xi_p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_p = eta_p - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    meridian = 75.0 + 3.0 * (wkid - GAUSS_KRUGER_WKIDS.start)
    return meridian + F.degrees(F.atan2(F.sinh(eta_p), F.cos(xi_p))), F.degrees(lat)


def tile_x(lon: Column, z: int) -> Column:
    side = 1 << z
    return F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((lon + 180.0) / 360.0 * side))).cast("long")


def tile_y(lat: Column, z: int) -> Column:
    side = 1 << z
    phi = F.radians(lat)
    frac = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2
    return F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor(frac * side))).cast("long")


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a tile; raises on an impossible address."""
    side = 1 << z
    if not (0 <= z <= 24 and 0 <= x < side and 0 <= y < side):
        raise ValueError(f"no tile {z}/{x}/{y}")

    def north_edge(row: int) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / side))))
    return x / side * 360 - 180, north_edge(y + 1), (x + 1) / side * 360 - 180, north_edge(y)


def ring_area_m2(ring: Column) -> Column:
    """Unsigned spherical area of a closed ring of ``struct<x,y>`` degrees."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1),
                       lambda a, b: F.radians(b["x"] - a["x"])
                       * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"]))))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
    return F.abs(total) * (EARTH_RADIUS_M ** 2 / 2)


def polygon_area_m2(rings: Column) -> Column:
    """Outer ring minus holes."""
    areas = F.transform(rings, ring_area_m2)
    holes = F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))), F.lit(0.0), lambda s, v: s + v)
    return F.element_at(areas, 1) - holes


def destination(lon: Column, lat: Column, metres: float, bearing_deg: Column) -> tuple[Column, Column]:
    """Point reached on the sphere from (lon, lat)."""
    ang = metres / EARTH_RADIUS_M
    phi, theta = F.radians(lat), F.radians(bearing_deg)
    sin_phi2 = F.sin(phi) * math.cos(ang) + F.cos(phi) * math.sin(ang) * F.cos(theta)
    lam = F.atan2(F.sin(theta) * math.sin(ang) * F.cos(phi), math.cos(ang) - F.sin(phi) * sin_phi2)
    return lon + F.degrees(lam), F.degrees(F.asin(sin_phi2))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over the closed ring."""
    n = F.size(ring)
    crossings = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.when(
        ((a["y"] > y) != (b["y"] > y))
        & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    return F.aggregate(crossings, F.lit(0), lambda s, v: s + v) % 2 == 1
