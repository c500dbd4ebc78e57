"""Rasters as tables of pixels (x, y, band, value): cleaning, combining, coarsening,
sampling and pyramids.  One pixel axis is used throughout, y growing downwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.bits import right
from tilewright.operators import covering, loops


def by_pixel(pixels: DataFrame, *keys: str) -> DataFrame:
    """One row a pixel with its bands as an array, in order of band."""
    return pixels.groupBy(*keys, "x", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "value"))), lambda p: p["value"]).alias("bands"))


def total(bands: Column) -> Column:
    return F.aggregate(bands, F.lit(0), lambda s, v: s + v)


def is_null(bands: Column, least: int) -> Column:
    """Whether the sum over the bands is below ``least`` for each of them."""
    return total(bands) < least * F.size(bands)


def to_bands(rows: DataFrame) -> DataFrame:
    keys = [c for c in rows.columns if c != "bands"]
    return rows.select(*keys, F.posexplode("bands").alias("band", "value"))


def combine(pixels: DataFrame, layer: str, least: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The last layer whose pixel isn't null wins; pixels without one are 0.
    (keys, x, y, bands)"""
    rows = by_pixel(pixels, layer, *keys)
    order = F.when(~is_null(F.col("bands"), least), F.col(layer))
    best = rows.groupBy(*keys, "x", "y").agg(F.max_by("bands", order).alias("best"), F.max(F.size("bands")).alias("n"))
    return best.select(*keys, "x", "y", F.coalesce("best", F.array_repeat(F.lit(0), F.col("n"))).alias("bands"))


def coarsen(pixels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Halves both axes: per band the rounded mean of a 2 x 2 block, missing pixels count 0."""
    keys = [*keep, right(F.col("x"), 1).cast("int").alias("x"), right(F.col("y"), 1).cast("int").alias("y"), "band"]
    return pixels.groupBy(*keys).agg(right(F.sum("value") + 2, 2).cast("int").alias("value"))


def coarsen_strict(pixels: DataFrame, least: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`coarsen`, but a block with a low or missing pixel is 0 (one band)."""
    keys = [*keep, right(F.col("x"), 1).cast("int").alias("x"), right(F.col("y"), 1).cast("int").alias("y"), "band"]
    low = (F.min("value") < least) | (F.count("*") < 4)
    return pixels.groupBy(*keys).agg(F.when(low, 0).otherwise(right(F.sum("value") + 2, 2)).cast("int").alias("value"))


def pyramid(pixels: DataFrame, levels: int, step: Callable[[DataFrame], DataFrame] = coarsen) -> DataFrame:
    """(level, x, y, band, value) from the finest (``levels``) to the coarsest (0)."""
    now = pixels.select("x", "y", "band", "value")
    out = now.withColumn("level", F.lit(levels))
    for level in range(levels - 1, -1, -1):
        now = step(now)
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out


def damaged(changed: DataFrame, levels: int) -> DataFrame:
    """(level, x, y) of all ancestors of changed tiles (x, y) at level ``levels``:
    one generation of rows, no loop over levels."""
    ups = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("up")
    rows = changed.select("x", "y", ups)
    return rows.select((F.lit(levels) - F.col("up")).alias("level"), right(F.col("x"), F.col("up")).alias("x"), right(F.col("y"), F.col("up")).alias("y")).distinct()


def update(old: DataFrame, changed: DataFrame, levels: int, step: Callable[[DataFrame], DataFrame] = coarsen) -> DataFrame:
    """An old pyramid with the finest level's ``changed`` pixels: only blocks above
    them are computed anew, level by level; all others stay as they are."""
    loops.ensure_checkpoint_dir(old.sparkSession)
    fresh = changed.select("x", "y", "band", "value").checkpoint()
    out = old.where(F.col("level") == levels).join(fresh.select("x", "y").distinct(), ["x", "y"], "left_anti").select("level", "x", "y", "band", "value").unionByName(fresh.withColumn("level", F.lit(levels)))
    below, touched = out.where(F.col("level") == levels), fresh.select("x", "y").distinct()
    for level in range(levels - 1, -1, -1):
        blocks = touched.select(right(F.col("x"), 1).cast("int").alias("bx"), right(F.col("y"), 1).cast("int").alias("by")).distinct()
        source = below.withColumn("bx", right(F.col("x"), 1)).withColumn("by", right(F.col("y"), 1)).join(blocks, ["bx", "by"], "left_semi")
        now = step(source.select("x", "y", "band", "value")).withColumn("level", F.lit(level)).checkpoint()  # each level reads the one below: without, plans double
        touched = blocks.select(F.col("bx").alias("x"), F.col("by").alias("y"))
        same = old.where(F.col("level") == level).join(touched, ["x", "y"], "left_anti").select("level", "x", "y", "band", "value")
        below = same.unionByName(now)
        out = out.unionByName(below)
    return out


def remap(value: Column, black_in: int, black_out: int, white_in: int, white_out: int, below: int = 0) -> Column:
    """A piecewise linear table in integers; values under ``below`` become 0."""
    line = black_out + F.expr("0") + F.floor((white_out - black_out) * (value - black_in) / F.lit(float(white_in - black_in))).cast("int")
    return F.when(value < below, 0).when(value < black_in, black_out).when(value < white_in, line).otherwise(white_out).cast("int")


def bilinear(points: DataFrame, pixels: DataFrame, missing: int) -> DataFrame:
    """points (id, px, py in pixels) with the interpolated ``value`` of a one-band
    raster (x, y, value): weighted if all four neighbours are valid, else the first
    valid one in the order of rows, else null."""
    x, y = F.col("px").cast("int"), F.col("py").cast("int")
    corner = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (x + dx).alias("x"), (y + dy).alias("y")) for n, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))])).alias("c")
    asks = points.select("id", "px", "py", corner).select("id", "px", "py", "c.n", "c.x", "c.y")
    valid = pixels.where(F.col("value") != missing).select("x", "y", "value")
    rows = asks.join(valid, ["x", "y"], "left")
    v = [F.max(F.when(F.col("n") == n, F.col("value"))) for n in range(4)]
    sums = rows.groupBy("id", "px", "py").agg(*[c.alias(f"v{n}") for n, c in enumerate(v)])
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    blend = (F.col("v0") * (1 - fx) + F.col("v1") * fx) * (1 - fy) + (F.col("v2") * (1 - fx) + F.col("v3") * fx) * fy
    whole = F.col("v0").isNotNull() & F.col("v1").isNotNull() & F.col("v2").isNotNull() & F.col("v3").isNotNull()
    return sums.select("id", F.when(whole, (blend + 0.5).cast("int")).otherwise(F.coalesce("v0", "v1", "v2", "v3")).alias("value"))


def first_valid(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """points (id, lon, lat) with the value of the first tile, by number, that holds
    them; tiles are (tile, west, south, east, north, value); null values are invalid."""
    valid = tiles.where(F.col("value").isNotNull())
    bounds = lambda *at: (covering.inside(*at), F.col("tile"), F.col("tile"))
    hit = covering.candidates(points, valid, "tile", size, 3, bounds).where("lon >= west and lon <= east and lat >= south and lat <= north")
    return hit.groupBy("id").agg(F.min_by("value", "tile").alias("value"), F.min("tile").alias("tile"))
