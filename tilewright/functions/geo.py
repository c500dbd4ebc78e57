"""Spherical geometry, camera projection and weather formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378000.0


def xyz(lon: Column, lat: Column, h: Column, radius: float = RADIUS) -> tuple[Column, Column, Column]:
    """z points to longitude 0, y to the north pole."""
    a, b = F.radians(lon), F.radians(lat)
    r = radius + h
    return F.sin(a) * F.cos(b) * r, F.sin(b) * r, F.cos(a) * F.cos(b) * r


def lonlat(x: Column, y: Column, z: Column, radius: float = RADIUS) -> tuple[Column, Column, Column]:
    """(lon, lat, h); the zero vector counts as of length 1."""
    length = F.sqrt(x * x + y * y + z * z)
    d = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.degrees(F.atan2(x / d, z / d)), F.degrees(F.atan2(y / d, F.sqrt(x * x + z * z) / d)), d - radius


def ground(x: Column, y: Column, z: Column, radius: float = RADIUS) -> tuple[Column, Column, Column]:
    length = F.sqrt(x * x + y * y + z * z)
    s = F.when(length == 0, F.lit(0.0)).otherwise(radius / length)
    return x * s, y * s, z * s


def frame(lon: Column, lat: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Unit vectors up, north and east of a place."""
    a, b = F.radians(lon), F.radians(lat)
    return {
        "up": (F.sin(a) * F.cos(b), F.sin(b), F.cos(a) * F.cos(b)),
        "north": (-F.sin(a) * F.sin(b), F.cos(b), -F.cos(a) * F.sin(b)),
        "east": (F.cos(a), F.lit(0.0), -F.sin(a)),
    }


def angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle angle in radians; the cosine is clamped."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    out = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(out + 360.0, F.lit(360.0))


def slerp(a: tuple[Column, ...], b: tuple[Column, ...], t: Column) -> tuple[Column, ...]:
    """Between unit vectors; nearly equal ones are blended in a straight line."""
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))))
    w = F.acos(dot)
    near = F.sin(w) < 1e-9
    p = F.when(near, 1 - t).otherwise(F.sin((1 - t) * w) / F.sin(w))
    q = F.when(near, t).otherwise(F.sin(t * w) / F.sin(w))
    return tuple(x * p + y * q for x, y in zip(a, b, strict=True))


def wrap(degrees: Column) -> Column:
    """Into -180 (included) to 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def smoothstep(t: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return u * u * (3 - 2 * u)


def web_mercator(lon: Column, lat: Column, radius: float = 6378137.0) -> tuple[Column, Column]:
    return F.radians(lon) * radius, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * radius


def project(m: list[float], x: Column, y: Column, z: Column, width: float, height: float) -> tuple[Column, Column, Column]:
    """(pixel x, pixel y, visible) by a row-major 4x4 matrix; visible: in front and inside."""
    clip = [m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(4)]
    w = F.when(clip[3] > 0, clip[3])
    nx, ny = clip[0] / w, clip[1] / w
    seen = F.coalesce((F.abs(nx) <= 1) & (F.abs(ny) <= 1) & (F.abs(clip[2] / w) <= 1), F.lit(False))
    return (nx + 1) * (width / 2), (1 - ny) * (height / 2), seen


def look_at(eye: tuple[float, ...], target: tuple[float, ...], up: tuple[float, ...]) -> list[float]:
    """Row-major view matrix, on the driver."""

    def unit(v: list[float]) -> list[float]:
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    def cross(a: list[float], b: list[float]) -> list[float]:
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    f = unit([t - e for t, e in zip(target, eye, strict=True)])
    s = unit(cross(f, list(up)))
    u = cross(s, f)
    rows = [s, u, [-x for x in f]]
    return [x for r in rows for x in (*r, -sum(a * b for a, b in zip(r, eye, strict=True)))] + [0.0, 0.0, 0.0, 1.0]


def perspective(fov: float, aspect: float, near: float, far: float) -> list[float]:
    f = 1 / math.tan(fov / 2)
    return [f / aspect, 0, 0, 0, 0, f, 0, 0, 0, 0, (far + near) / (near - far), 2 * far * near / (near - far), 0, 0, -1, 0]


def multiply(a: list[float], b: list[float]) -> list[float]:
    return [sum(a[4 * r + k] * b[4 * k + c] for k in range(4)) for r in range(4) for c in range(4)]


def planes(m: list[float]) -> list[tuple[float, float, float, float]]:
    """The six clip planes of a projection-view matrix; inside is positive."""
    rows = [m[4 * r : 4 * r + 4] for r in range(4)]
    out = []
    for r in range(3):
        for sign in (1, -1):
            p = [rows[3][c] + sign * rows[r][c] for c in range(4)]
            n = math.sqrt(sum(x * x for x in p[:3]))
            out.append(tuple(x / n for x in p))
    return out


def box_visible(box: tuple[Column, ...], clip: list[tuple[float, float, float, float]]) -> Column:
    """Whether a box (min x, y, z, max x, y, z) has a corner inside of each plane."""
    out = F.lit(True)
    for a, b, c, d in clip:
        far = [box[k + 3] if n >= 0 else box[k] for k, n in enumerate((a, b, c))]
        out = out & (a * far[0] + b * far[1] + c * far[2] + d >= 0)
    return out


def clip_segment(a: tuple[Column, ...], b: tuple[Column, ...], clip: list[tuple[float, float, float, float]]) -> tuple[Column, Column]:
    """The part of a segment inside all planes, as shares of the way from a to b; nulls if
    there is none.  Each plane holds it back at the end that lies outside."""
    first, last, seen = F.lit(0.0), F.lit(1.0), F.lit(True)
    for plane in clip:
        here, there = (sum((n * v for n, v in zip(plane[:3], p, strict=True)), F.lit(plane[3])) for p in (a, b))
        cross = here / (here - there)
        first = F.when((here < 0) & (there >= 0), F.greatest(first, cross)).otherwise(first)
        last = F.when((here >= 0) & (there < 0), F.least(last, cross)).otherwise(last)
        seen = seen & ((here >= 0) | (there >= 0))
    fine = seen & (first <= last)
    return F.when(fine, first), F.when(fine, last)


# weather

def vapour_pressure(temperature: Column) -> Column:
    """hPa over water."""
    return 6.112 * F.pow(F.lit(10.0), 7.5 * temperature / (237.7 + temperature))


def relative_humidity(temperature: Column, dew: Column) -> Column:
    return 100.0 * vapour_pressure(dew) / vapour_pressure(temperature)


def humidex(temperature: Column, dew: Column) -> Column:
    return temperature + 5.0 / 9.0 * (vapour_pressure(dew) - 10.0)


def wind_chill(temperature: Column, kmh: Column) -> Column:
    v = F.pow(kmh, 0.16)
    return F.when((temperature <= 10) & (kmh > 4.8), 13.12 + 0.6215 * temperature - 11.37 * v + 0.3965 * temperature * v).otherwise(temperature)


SECTORS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
# fixed values: upper limits of the Beaufort numbers in knots
BEAUFORT = (0, 3, 6, 10, 16, 21, 27, 33, 40, 47, 55, 63)


def wind_sector(degrees: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SECTORS]), (F.floor(degrees / 22.5).cast("int") % 16) + 1)


def beaufort(knots: Column) -> Column:
    out = F.lit(12)
    for n, top in reversed(list(enumerate(BEAUFORT))):
        out = F.when(knots <= top, n).otherwise(out)
    return out.cast("int")
