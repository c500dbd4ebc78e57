"""Warping of rasters into quads of a global pyramid level.

Source pixels are kept as blocks, one row each, with the first column and row of the
next blocks beside them, so every output pixel takes its four neighbours from one
block and blocks are resampled apart.  Output pixels are mapped back into the source;
what several sources cover is combined afterwards, the last one in order on top.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import raster

#: Edge of a block in pixels.
BLOCK = 256
#: Degrees of a quad at level 0; quads count from the north-west.
DEGREES = 180.0


def blocks(pixels: DataFrame, size: int = BLOCK) -> DataFrame:
    """(raster, bx, by, band, places, values) from pixels (raster, x, y, band, value):
    square blocks with one column and row of the next ones; a place is row * (size + 1) + column.
    Pixels that are null or not there have no place."""

    rows, place = _owned(pixels, size)
    entry = F.sort_array(F.collect_list(F.struct(place.cast("int").alias("place"), F.col("value").cast("int").alias("value"))))  # (size + 1)^2 at most
    found = rows.groupBy("raster", "bx", "by", "band").agg(entry.alias("entries"))
    return found.select("raster", "bx", "by", "band", F.col("entries.place").alias("places"), F.col("entries.value").alias("values"))


def _owned(pixels: DataFrame, size: int) -> tuple[DataFrame, Column]:
    """The known pixels with bx, by, once for each block that holds them, and their place there."""

    def owners(v: str) -> Column:
        own = F.floor(F.col(v) / size).cast("int")
        return F.explode(F.when((F.col(v) % size == 0) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own)))

    rows = pixels.where(F.col("value").isNotNull()).withColumn("bx", owners("x")).withColumn("by", owners("y"))
    return rows, (F.col("y") - F.col("by") * size) * (size + 1) + F.col("x") - F.col("bx") * size


def banded_blocks(pixels: DataFrame, size: int = BLOCK) -> DataFrame:
    """(raster, bx, by, bands, places, values): as ``blocks``, with all bands of a block in one row."""
    rows, place = _owned(pixels, size)
    entry = F.collect_list(F.struct(F.col("band").cast("int").alias("band"), place.cast("int").alias("place"), F.col("value").cast("int").alias("value")))  # so many times the bands
    found = rows.groupBy("raster", "bx", "by").agg(entry.alias("entries"))
    return found.select("raster", "bx", "by", F.col("entries.band").alias("bands"), F.col("entries.place").alias("places"), F.col("entries.value").alias("values"))


def level_for(step: Column, pixels: int, levels: int) -> Column:
    """The coarsest level whose pixels are no larger than ``step`` degrees, ``levels`` at most."""
    out = F.lit(0)
    for level in range(levels):
        out = out + (F.lit(DEGREES / (1 << level) / pixels) > step).cast("int")
    return out


def resampled(source: dict, bx: int, by: int, values: np.ndarray, known: np.ndarray, size: int, pixels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, value) of the output pixels of a source's level whose upper left neighbour
    lies in a block: the mean of the known ones of four source pixels, weighted by
    nearness, rounded.  Columns and rows count from the north-west over all quads."""
    w, h = source["width"], source["height"]
    x0, ax, ay, y0, bxx, byy = (source[c] for c in ("x0", "x_col", "x_row", "y0", "y_col", "y_row"))
    step = DEGREES / (1 << source["level"]) / pixels
    # the part of the source that the block answers for; what lies half a pixel beyond the edge belongs to it too
    left, top = (0.0 if bx == 0 else bx * size + 0.5), (0.0 if by == 0 else by * size + 0.5)
    right, bottom = min(float(w), (bx + 1) * size + 0.5), min(float(h), (by + 1) * size + 0.5)
    u, v = np.array([left, right, left, right]), np.array([top, top, bottom, bottom])
    lon, lat = x0 + ax * u + ay * v, y0 + bxx * u + byy * v
    columns, rows = 2 * pixels << source["level"], pixels << source["level"]
    xs = np.arange(max(0, int(np.floor((lon.min() + 180) / step)) - 1), min(columns, int(np.ceil((lon.max() + 180) / step)) + 1))
    ys = np.arange(max(0, int(np.floor((90 - lat.max()) / step)) - 1), min(rows, int(np.ceil((90 - lat.min()) / step)) + 1))
    x, y = (g.ravel() for g in np.meshgrid(xs, ys))
    lon, lat = (x + 0.5) * step - 180, 90 - (y + 0.5) * step
    det = ax * byy - ay * bxx
    u, v = ((lon - x0) * byy - (lat - y0) * ay) / det, ((lat - y0) * ax - (lon - x0) * bxx) / det
    i, j = np.floor(u - 0.5).astype(np.int64), np.floor(v - 0.5).astype(np.int64)
    mine = (u >= 0) & (u < w) & (v >= 0) & (v < h) & (np.clip(i, 0, w - 1) // size == bx) & (np.clip(j, 0, h - 1) // size == by)
    x, y, u, v, i, j = (a[mine] for a in (x, y, u, v, i, j))
    fx, fy = u - 0.5 - i, v - 0.5 - j
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for dj in (0, 1):
        for di in (0, 1):
            p, q = i + di - bx * size, j + dj - by * size
            inside = (p >= 0) & (q >= 0) & (i + di < w) & (j + dj < h)
            at = np.where(inside, q * (size + 1) + p, 0)
            part = np.where(inside & known[at], (fx if di else 1 - fx) * (fy if dj else 1 - fy), 0.0)
            total = total + part * values[at]
            weight = weight + part
    fine = weight > 1e-5
    return x[fine], y[fine], np.floor(total[fine] / weight[fine] + 0.5).astype(np.int64)


def warp(sources: DataFrame, source_blocks: DataFrame, pixels: int, bands: int = 3, size: int = BLOCK) -> DataFrame:
    """(raster, level, x, y, band, value): every source in the pixels of its level.

    sources: (raster, width, height, bands, level and the affine map from columns and
    rows to degrees: lon = x0 + x_col * column + x_row * row, lat likewise with y).
    A source of one band is put into all; any other number than ``bands`` is an error.
    Places outside the source or without a known neighbour have no row."""
    meta = ["width", "height", "level", "x0", "x_col", "x_row", "y0", "y_col", "y_row"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                values, known = np.zeros((size + 1) ** 2, np.int64), np.zeros((size + 1) ** 2, bool)
                values[r["places"]], known[r["places"]] = r["values"], True
                x, y, v = resampled(r, r["bx"], r["by"], values, known, size, pixels)
                yield pd.DataFrame({"raster": np.full(len(x), r["raster"], np.int64), "level": np.full(len(x), r["level"], np.int32), "x": x, "y": y, "band": np.full(len(x), r["band"], np.int32), "value": v})

    count = F.when((F.col("bands") == 1) | (F.col("bands") == bands), F.col("bands")).otherwise(F.raise_error(F.concat(F.lit("unsupported number of bands: "), F.col("bands").cast("string"))))
    checked = sources.withColumn("bands", count)
    rows = source_blocks.join(checked.select("raster", *meta), "raster").mapInPandas(run, "raster long, level int, x long, y long, band int, value long")
    alone = checked.where("bands = 1").select("raster", F.lit(True).alias("alone"))
    every = F.when(F.col("alone"), F.sequence(F.lit(0), F.lit(bands - 1))).otherwise(F.array("band"))
    return rows.join(alone, "raster", "left").select("raster", "level", "x", "y", F.explode(every).alias("band"), F.col("value").cast("int").alias("value"))


#: Output pixels that a kernel maps back at once, but for a single larger block.
MOST_PIXELS = 1_000_000


def _resampled(f: pd.DataFrame, pixels: int, size: int, bands: int) -> pd.DataFrame:
    """``resampled`` for many blocks at once, with an array of the bands' values for each output
    pixel; bands without a known neighbour there are left out."""
    c = {name: f[name].to_numpy() for name in ("width", "height", "level", "x0", "x_col", "x_row", "y0", "y_col", "y_row", "bx", "by", "raster", "alone")}
    step = DEGREES / (1 << c["level"]) / pixels
    left, top = (np.where(c[v] == 0, 0.0, c[v] * size + 0.5) for v in ("bx", "by"))
    right, bottom = (np.minimum(c[n].astype(float), (c[v] + 1) * size + 0.5) for n, v in (("width", "bx"), ("height", "by")))
    u, v = np.stack([left, right, left, right]), np.stack([top, top, bottom, bottom])
    lon, lat = c["x0"] + c["x_col"] * u + c["x_row"] * v, c["y0"] + c["y_col"] * u + c["y_row"] * v
    columns, rows = 2 * pixels << c["level"], pixels << c["level"]
    west, east = np.maximum(0, np.floor((lon.min(axis=0) + 180) / step).astype(np.int64) - 1), np.minimum(columns, np.ceil((lon.max(axis=0) + 180) / step).astype(np.int64) + 1)
    north, south = np.maximum(0, np.floor((90 - lat.max(axis=0)) / step).astype(np.int64) - 1), np.minimum(rows, np.ceil((90 - lat.min(axis=0)) / step).astype(np.int64) + 1)
    wide = np.maximum(east - west, 0)
    count = wide * np.maximum(south - north, 0)
    at = np.repeat(np.arange(len(f)), count)
    n = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    x, y = west[at] + n % wide[at], north[at] + n // wide[at]
    lon, lat = (x + 0.5) * step[at] - 180, 90 - (y + 0.5) * step[at]
    det = c["x_col"] * c["y_row"] - c["x_row"] * c["y_col"]
    u = ((lon - c["x0"][at]) * c["y_row"][at] - (lat - c["y0"][at]) * c["x_row"][at]) / det[at]
    v = ((lat - c["y0"][at]) * c["x_col"][at] - (lon - c["x0"][at]) * c["y_col"][at]) / det[at]
    i, j = np.floor(u - 0.5).astype(np.int64), np.floor(v - 0.5).astype(np.int64)
    w, h = c["width"][at], c["height"][at]
    mine = (u >= 0) & (u < w) & (v >= 0) & (v < h) & (np.clip(i, 0, w - 1) // size == c["bx"][at]) & (np.clip(j, 0, h - 1) // size == c["by"][at])
    at, x, y, u, v, i, j, w, h = (a[mine] for a in (at, x, y, u, v, i, j, w, h))
    fx, fy = u - 0.5 - i, v - 0.5 - j
    values, known = np.zeros((len(f), bands, (size + 1) ** 2), np.int64), np.zeros((len(f), bands, (size + 1) ** 2), bool)
    whose = np.repeat(np.arange(len(f)), f["places"].map(len))
    where = (whose, *(np.concatenate(f[name].to_numpy()) for name in ("bands", "places"))) if len(whose) else (whose, whose, whose)
    values[where], known[where] = np.concatenate(f["values"].to_numpy()) if len(whose) else 0, True
    total, weight = np.zeros((len(x), bands)), np.zeros((len(x), bands))
    for dj in (0, 1):
        for di in (0, 1):
            p, q = i + di - c["bx"][at] * size, j + dj - c["by"][at] * size
            inside = (p >= 0) & (q >= 0) & (i + di < w) & (j + dj < h)
            place = np.where(inside, q * (size + 1) + p, 0)
            part = np.where(inside[:, None] & known[at, :, place], ((fx if di else 1 - fx) * (fy if dj else 1 - fy))[:, None], 0.0)
            total = total + part * values[at, :, place]
            weight = weight + part
    fine = weight > 1e-5
    out = np.floor(total / np.where(fine, weight, 1) + 0.5).astype(np.int32)
    alone = c["alone"][at]
    out[alone], fine[alone] = out[alone][:, :1], fine[alone][:, :1]
    some = fine.any(axis=1)
    at, x, y, out, fine = at[some], x[some], y[some], out[some], fine[some]
    lists = np.split(out[fine], np.cumsum(fine.sum(axis=1))[:-1]) if len(at) else []
    return pd.DataFrame({"level": c["level"][at].astype(np.int32), "x": x, "y": y, "raster": c["raster"][at], "bands": lists})


def last_pixels(sources: DataFrame, source_blocks: DataFrame, pixels: int, least: int = 1, bands: int = 3, size: int = BLOCK) -> DataFrame:
    """(level, x, y, bands): what ``raster.combine`` gives of ``warp``, from ``banded_blocks``: of a
    task's blocks only the last source of each pixel goes on, so that what is shuffled is
    bounded by the pixels of all levels."""
    meta = ["width", "height", "level", "x0", "x_col", "x_row", "y0", "y_col", "y_row"]
    most = MOST_PIXELS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            # about the pixels of each block's box, by its area
            area = np.abs(f["x_col"] * f["y_row"] - f["x_row"] * f["y_col"]) * (size + 2.0) ** 2 / (DEGREES / (1 << f["level"].to_numpy()) / pixels) ** 2
            for _, part in f.groupby((4 * area.cumsum() // most).to_numpy()):
                yield _resampled(part, pixels, size, bands)

    count = F.when((F.col("bands") == 1) | (F.col("bands") == bands), F.col("bands")).otherwise(F.raise_error(F.concat(F.lit("unsupported number of bands: "), F.col("bands").cast("string"))))
    checked = sources.select("raster", *meta, (count == 1).alias("alone"))
    warped = source_blocks.join(checked, "raster").mapInPandas(run, "level int, x long, y long, raster long, bands array<int>")
    order = F.when(~raster.is_null(F.col("bands"), least), F.col("raster"))
    best = warped.groupBy("level", "x", "y").agg(F.max_by("bands", order).alias("best"), F.max(F.size("bands")).alias("n"))
    return best.select("level", "x", "y", F.coalesce("best", F.array_repeat(F.lit(0), F.col("n"))).alias("bands"))


def insert(warped: DataFrame, pixels: int, least: int = 1) -> DataFrame:
    """(level, quad_x, quad_y, x, y, band, value): the quads' pixels, of several sources
    the last one that isn't null there; x and y count within the quad."""
    return in_quads(raster.combine(warped, "raster", least, ("level",)), pixels)


def in_quads(combined: DataFrame, pixels: int) -> DataFrame:
    """(level, quad_x, quad_y, x, y, band, value) of (level, x, y, bands)."""
    whole = raster.to_bands(combined)
    quad = [F.floor(F.col(c) / pixels).cast("int").alias(f"quad_{c}") for c in "xy"]
    return whole.select("level", *quad, *((F.col(c) % pixels).cast("int").alias(c) for c in "xy"), "band", "value")
