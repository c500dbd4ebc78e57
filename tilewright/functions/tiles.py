"""Tile selection, tile paths and urls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.bits import right

MOST_LEVEL = 28
SPAN = 180.0


def closest_level(units_per_pixel: Column, tile_width: Column | int, most: int) -> Column:
    """The level whose resolution is nearest (the coarser on a tie); null if the
    one beyond ``most`` would be nearer, and for a resolution that isn't positive.

    Nearest in the difference, not the ratio: the borders are at 3/4 of a level's
    resolution, so the level follows from one logarithm."""
    base = SPAN / F.lit(tile_width).cast("double") if isinstance(tile_width, int) else SPAN / tile_width.cast("double")
    tests = F.sequence(F.lit(0), F.lit(most + 1))
    deltas = F.transform(tests, lambda level: F.struct(F.abs(units_per_pixel - base / F.pow(F.lit(2.0), level)).alias("delta"), level.alias("level")))
    best = F.array_min(deltas)["level"]
    good = units_per_pixel.isNotNull() & ~F.isnan(units_per_pixel) & (units_per_pixel > 0) & (units_per_pixel < float("inf"))
    return F.when(good & (best <= most), best)


def select_level(west: Column, south: Column, east: Column, north: Column, level: Column, most: int, offset: int = 0) -> Column:
    """Struct (level, matrix, row, col) of the tile that holds the centre of a box;
    null for an empty box, one beyond the world, or a level out of range."""
    rows = F.pow(F.lit(2.0), level)
    span = SPAN / rows
    col = F.floor((0.5 * (west + east) + 180.0) / span)
    up = F.floor((0.5 * (south + north) + 90.0) / span)
    fine = level.between(0, most) & (west >= -180) & (east <= 180) & (south >= -90) & (north <= 90) & (west < east) & (south < north) & (col >= 0) & (col < 2 * rows) & (up >= 0) & (up < rows)
    return F.when(fine, F.struct(level.cast("int").alias("level"), (level + offset).cast("int").alias("matrix"), (rows - 1 - up).cast("int").alias("row"), col.cast("int").alias("col")))


def tile_bounds(level: Column, row: Column, col: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) of a tile of the global grid, 2 x 1 at level 0."""
    span = SPAN / F.pow(F.lit(2.0), level)
    west, north = col * span - 180.0, 90.0 - row * span
    return west, north - span, west + span, north


def point_tile(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    """(row, col) of the tile of a point; the far edges belong to the last tiles."""
    rows = 1 << level
    col = F.least(F.floor((lon + 180.0) / (SPAN / rows)), F.lit(2 * rows - 1)).cast("int")
    up = F.least(F.floor((lat + 90.0) / (SPAN / rows)), F.lit(rows - 1)).cast("int")
    return rows - 1 - up, col


def subdomain(row: Column, col: Column, n: int) -> Column:
    return F.pmod(row + col, F.lit(n))


def tile_path(level: Column, row: Column, col: Column, extension: str) -> Column:
    """LL/yyyy/yyyy/xxxx/xxxx.ext: quotient and remainder by 4096, y first."""
    return F.format_string(f"%02d/%04d/%04d/%04d/%04d.{extension}", level, right(row, 12), row.bitwiseAND(F.lit(4095)), right(col, 12), col.bitwiseAND(F.lit(4095)))


def tile_url(template: str, level: Column, row: Column, col: Column, hosts: str = "0123") -> Column:
    """Fills {s}, {z}, {y} and {x}."""
    out = F.replace(F.lit(template), F.lit("{z}"), level.cast("string"))
    out = F.replace(out, F.lit("{y}"), row.cast("string"))
    out = F.replace(out, F.lit("{x}"), col.cast("string"))
    return F.replace(out, F.lit("{s}"), F.substring(F.lit(hosts), subdomain(row, col, len(hosts)) + 1, F.lit(1)))
