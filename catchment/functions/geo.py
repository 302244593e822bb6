"""Geometry columns: distances, projections and validity. Degrees are WGS84; lengths are metres."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c

#: Mean earth radii in use: assessments, and drawings.
RADIUS, RADIUS_DRAWING = 6371000.0, 6371008.8
#: Metres a degree for short distances: longitude at the equator, latitude.
DEGREE_LON, DEGREE_LAT = 111320.0, 110540.0


def haversine(lat1, lon1, lat2, lon2, radius: float = RADIUS) -> Column:
    """Great-circle metres, arc-tangent form."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def haversine_asin(lat1, lon1, lat2, lon2, radius: float = RADIUS) -> Column:
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    x, y = F.sin((c - a) / 2), F.sin((d - b) / 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(x * x + F.cos(a) * F.cos(c) * y * y))


def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of a nearby origin."""
    lat0 = _c(lat0)
    return (_c(lon) - _c(lon0)) * F.lit(DEGREE_LON) * F.cos(F.radians(lat0)), (_c(lat) - lat0) * F.lit(DEGREE_LAT)


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square > 0, square)))).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + t * dx), F.lit(2.0)) + F.pow(py - (ay + t * dy), F.lit(2.0)))


def valid_coordinates(lat, lon) -> Column:
    lat, lon = _c(lat), _c(lon)
    ok = lambda x, most: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most)
    return F.coalesce(ok(lat, 90.0) & ok(lon, 180.0), F.lit(False))


def in_united_kingdom(lat, lon) -> Column:
    """Within the box of fixed limits that holds the United Kingdom."""
    return _c(lat).between(49.5, 61.1) & _c(lon).between(-8.7, 2.2)


def travel_seconds(metres, mode: str, rail: bool = False) -> Column:
    """Duration at the speed of a mode: walk 4.8 km/h, cycle 15.5 km/h (15 for rail access)."""
    speed = {"walk": 4.8, "cycle": 15.0 if rail else 15.5}[mode]
    return _c(metres) / F.lit(speed * 1000 / 3600)


def estimated_metres(straight, rail: bool = False) -> Column:
    """Travel distance where no route is known: 1.2 times the straight line, 1.25 for rail access."""
    return _c(straight) * F.lit(1.25 if rail else 1.2)


def web_mercator(lat, lon, zoom: int) -> tuple[Column, Column]:
    """World pixels at a zoom of 256-pixel tiles."""
    size = F.lit(256.0 * 2**zoom)
    y = F.asinh(F.tan(F.radians(_c(lat))))
    return (_c(lon) + 180.0) / 360.0 * size, (F.lit(1.0) - y / math.pi) / 2.0 * size


def from_web_mercator(x, y, zoom: int) -> tuple[Column, Column]:
    size = 256.0 * 2**zoom
    return F.degrees(F.atan(F.sinh((F.lit(1.0) - _c(y) * 2.0 / size) * math.pi))), _c(x) / size * 360.0 - 180.0


#: Airy 1830 and WGS84 ellipsoids, the national grid's transverse Mercator, and the seven-parameter shift from OSGB36 to WGS84 (metres, seconds, parts a million). Fixed values.
AIRY, WGS84 = (6377563.396, 6356256.909), (6378137.0, 6356752.314245)
GRID = {"scale": 0.9996012717, "lat": 49.0, "lon": -2.0, "east": 400000.0, "north": -100000.0}
SHIFT = {"tx": 446.448, "ty": -125.157, "tz": 542.060, "rx": 0.1502, "ry": 0.2470, "rz": 0.8421, "s": -20.4894}


def _shifted(lat, lon, src, dst, sign: int):
    """Degrees between datums by the seven-parameter shift, heights taken as 0."""
    import numpy as np

    a, b = src
    e2 = 1 - b * b / (a * a)
    phi, lam = np.radians(lat), np.radians(lon)
    nu = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    x, y, z = nu * np.cos(phi) * np.cos(lam), nu * np.cos(phi) * np.sin(lam), nu * (1 - e2) * np.sin(phi)
    rx, ry, rz = (sign * math.radians(SHIFT[k] / 3600) for k in ("rx", "ry", "rz"))
    s = 1 + sign * SHIFT["s"] * 1e-6
    x2 = sign * SHIFT["tx"] + s * x - rz * y + ry * z
    y2 = sign * SHIFT["ty"] + rz * x + s * y - rx * z
    z2 = sign * SHIFT["tz"] - ry * x + rx * y + s * z
    a, b = dst
    e2 = 1 - b * b / (a * a)
    p = np.hypot(x2, y2)
    phi = np.arctan2(z2, p * (1 - e2))
    for _ in range(8):
        nu = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        phi = np.arctan2(z2 + e2 * nu * np.sin(phi), p)
    return np.degrees(phi), np.degrees(np.arctan2(y2, x2))


def _meridian(phi, b, n, f0, phi0):
    import numpy as np

    d, s = phi - phi0, phi + phi0
    return b * f0 * (
        (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d
        - (3 * n + 3 * n**2 + 21 / 8 * n**3) * np.sin(d) * np.cos(s)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * np.sin(2 * d) * np.cos(2 * s)
        - 35 / 24 * n**3 * np.sin(3 * d) * np.cos(3 * s)
    )


def grid_of(lat, lon):
    """Numpy: national grid east and north of WGS84 degrees."""
    import numpy as np

    lat, lon = _shifted(lat, lon, WGS84, AIRY, -1)
    a, b = AIRY
    f0, phi0, lam0 = GRID["scale"], math.radians(GRID["lat"]), math.radians(GRID["lon"])
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    phi, l = np.radians(lat), np.radians(lon) - lam0
    sin, cos, t2 = np.sin(phi), np.cos(phi), np.tan(phi) ** 2
    nu = a * f0 / np.sqrt(1 - e2 * sin**2)
    rho = a * f0 * (1 - e2) / (1 - e2 * sin**2) ** 1.5
    eta = nu / rho - 1
    north = _meridian(phi, b, n, f0, phi0) + GRID["north"] + nu / 2 * sin * cos * l**2
    north += nu / 24 * sin * cos**3 * (5 - t2 + 9 * eta) * l**4 + nu / 720 * sin * cos**5 * (61 - 58 * t2 + t2**2) * l**6
    east = GRID["east"] + nu * cos * l + nu / 6 * cos**3 * (nu / rho - t2) * l**3
    east += nu / 120 * cos**5 * (5 - 18 * t2 + t2**2 + 14 * eta - 58 * t2 * eta) * l**5
    return east, north


def degrees_of(east, north):
    """Numpy: WGS84 degrees of national grid metres."""
    import numpy as np

    a, b = AIRY
    f0, phi0, lam0 = GRID["scale"], math.radians(GRID["lat"]), math.radians(GRID["lon"])
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    phi = np.full_like(np.asarray(north, float), phi0)
    for _ in range(12):
        phi = phi + (north - GRID["north"] - _meridian(phi, b, n, f0, phi0)) / (a * f0)
    sin, cos, t = np.sin(phi), np.cos(phi), np.tan(phi)
    nu = a * f0 / np.sqrt(1 - e2 * sin**2)
    rho = a * f0 * (1 - e2) / (1 - e2 * sin**2) ** 1.5
    eta, d = nu / rho - 1, east - GRID["east"]
    lat = phi - t / (2 * rho * nu) * d**2 + t / (24 * rho * nu**3) * (5 + 3 * t**2 + eta - 9 * t**2 * eta) * d**4 - t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4) * d**6
    lon = lam0 + d / (cos * nu) - (nu / rho + 2 * t**2) / (6 * cos * nu**3) * d**3 + (5 + 28 * t**2 + 24 * t**4) / (120 * cos * nu**5) * d**5
    lon -= (61 + 662 * t**2 + 1320 * t**4 + 720 * t**6) / (5040 * cos * nu**7) * d**7
    return _shifted(np.degrees(lat), np.degrees(lon), AIRY, WGS84, 1)


_PAIR = lambda a, b: T.StructType([T.StructField(a, T.DoubleType()), T.StructField(b, T.DoubleType())])


def _to_grid(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
    east, north = grid_of(lat.to_numpy(float), lon.to_numpy(float))
    return pd.DataFrame({"east": east, "north": north})


def _from_grid(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    lat, lon = degrees_of(east.to_numpy(float), north.to_numpy(float))
    return pd.DataFrame({"lat": lat, "lon": lon})


def to_grid(lat, lon) -> Column:
    """National grid (east, north) of WGS84 degrees."""
    return F.pandas_udf(_to_grid, _PAIR("east", "north"))(_c(lat).cast("double"), _c(lon).cast("double"))


def from_grid(east, north) -> Column:
    return F.pandas_udf(_from_grid, _PAIR("lat", "lon"))(_c(east).cast("double"), _c(north).cast("double"))


def cell(lat, lon, metres: float) -> tuple[Column, Column]:
    """Row and column of a grid of latitude bands and, within each band, cells that are at least metres wide everywhere in it."""
    step = metres / DEGREE_LAT
    row = F.floor(_c(lat) / step)
    return row, F.floor(_c(lon) / _cell_width(row, step))


def _cell_width(row: Column, step: float) -> Column:
    far = F.greatest(F.abs(row * step), F.abs((row + 1) * step))  # the band's edge nearer to a pole
    return F.lit(step * DEGREE_LAT / DEGREE_LON) / F.greatest(F.cos(F.radians(F.least(far, F.lit(89.0)))), F.lit(0.01))
