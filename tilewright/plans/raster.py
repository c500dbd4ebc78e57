"""Queries of the raster half: cleaning, combining, coarsening, sampling, pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.operators import covering, loops, raster
from tilewright.sources.tables import CUSTOMERS_SQL, LAT_SQL, LON_SQL, PIXELS_SQL, customers, latitude, longitude, pixels, table

LEAST = 40
_BANDS = f"(select raster, x, y, list(value order by band) as bands, sum(value)::int as total, count(*)::int as n from {PIXELS_SQL} group by raster, x, y)"


@query("pixel_counts", f"select raster, count(*) filter (total < {LEAST} * n) as null_pixels, count(*) filter (total >= {LEAST} * n) as pixels from {_BANDS} group by raster")
def pixel_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = raster.by_pixel(pixels(spark, folder), "raster")
    low = raster.is_null(F.col("bands"), LEAST)
    return rows.groupBy("raster").agg(F.count_if(low).alias("null_pixels"), F.count_if(~low).alias("pixels"))


@query("combined_layers", f"with b as (select x, y, arg_max(bands, raster) filter (total >= {LEAST} * n) as best from {_BANDS} group by x, y) select x, y, band, coalesce(best[band + 1], 0)::int as value from b, (select unnest(range(3))::int as band)")
def combined_layers(spark: SparkSession, folder: str) -> DataFrame:
    return raster.to_bands(raster.combine(pixels(spark, folder), "raster", LEAST)).select("x", "y", "band", "value")


@query("coarsened", f"select raster, x >> 1 as x, y >> 1 as y, band, ((sum(value) + 2)::bigint >> 2)::int as value from {PIXELS_SQL} group by raster, x >> 1, y >> 1, band")
def coarsened(spark: SparkSession, folder: str) -> DataFrame:
    return raster.coarsen(pixels(spark, folder), ("raster",))


@query("coarsened_strict", f"select raster, x >> 1 as x, y >> 1 as y, case when min(value) < 30 or count(*) < 4 then 0 else ((sum(value) + 2)::bigint >> 2)::int end as value from {PIXELS_SQL} where band = 0 group by raster, x >> 1, y >> 1")
def coarsened_strict(spark: SparkSession, folder: str) -> DataFrame:
    return raster.coarsen_strict(pixels(spark, folder).where("band = 0"), 30, ("raster",)).select("raster", "x", "y", "value")


_LEVELS = 6
_COMBINED = f"(with b as (select x, y, arg_max(bands, raster) filter (total >= {LEAST} * n) as best from {_BANDS} group by x, y) select x, y, band, coalesce(best[band + 1], 0)::int as value from b, (select unnest(range(3))::int as band))"


def _pyramid_sql(source: str) -> str:
    parts = [f"l{_LEVELS} as (select x, y, band, value from {source})"]
    for level in range(_LEVELS - 1, -1, -1):
        parts.append(f"l{level} as (select x >> 1 as x, y >> 1 as y, band, ((sum(value) + 2)::bigint >> 2)::int as value from l{level + 1} group by x >> 1, y >> 1, band)")
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select {level} as level, x, y, band, value from l{level}" for level in range(_LEVELS + 1))


def _finest(spark: SparkSession, folder: str) -> DataFrame:
    return raster.to_bands(raster.combine(pixels(spark, folder), "raster", LEAST))


@query("tile_pyramid", _pyramid_sql(_COMBINED))
def tile_pyramid(spark: SparkSession, folder: str) -> DataFrame:
    return raster.pyramid(_finest(spark, folder), _LEVELS).select("level", "x", "y", "band", "value")


_CHANGED = f"(select x, y, band, case when raster = 7 then 255 - value else value end as value from {PIXELS_SQL} where raster = 7)"


@query("pyramid_update", _pyramid_sql(f"(select * from {_CHANGED} union all select * from {_COMBINED} c where not exists (select 1 from {_CHANGED} k where k.x = c.x and k.y = c.y))"))
def pyramid_update(spark: SparkSession, folder: str) -> DataFrame:
    """A pyramid after one raster has changed: only the blocks above its pixels are rebuilt."""
    loops.ensure_checkpoint_dir(spark)
    old = raster.pyramid(_finest(spark, folder), _LEVELS).checkpoint()  # stands for the stored pyramid
    fresh = pixels(spark, folder).where("raster = 7").select("x", "y", "band", (255 - F.col("value")).alias("value"))
    return raster.update(old, fresh, _LEVELS).select("level", "x", "y", "band", "value")


@query("damaged_tiles", f"select distinct {_LEVELS} - up as level, (x >> up)::int as x, (y >> up)::int as y from {PIXELS_SQL}, (select unnest(range(1, {_LEVELS} + 1))::int as up) where raster = 7")
def damaged_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return raster.damaged(pixels(spark, folder).where("raster = 7").select("x", "y").distinct(), _LEVELS)


@query("remapped", f"select raster, x, y, band, (case when value < 10 then 0 when value < 20 then 5 when value < 230 then 5 + floor(245 * (value - 20) / 210.0e0)::int else 250 end)::int as value from {PIXELS_SQL}")
def remapped(spark: SparkSession, folder: str) -> DataFrame:
    return pixels(spark, folder).withColumn("value", raster.remap(F.col("value"), 20, 5, 230, 250, below=10))


_PX, _PY = "((lon + 180) / 360.0e0 * 62)", "((lat + 90) / 180.0e0 * 62)"


@query(
    "bilinear_samples",
    f"""with r as (select x, y, value from {PIXELS_SQL} where raster = 1 and band = 0 and value <> 0), p as (select id, {_PX} as px, {_PY} as py from {CUSTOMERS_SQL}),
v as (select id, px, py, a.value as v0, b.value as v1, c.value as v2, d.value as v3 from p left join r a on a.x = floor(px)::int and a.y = floor(py)::int left join r b on b.x = floor(px)::int + 1 and b.y = floor(py)::int left join r c on c.x = floor(px)::int and c.y = floor(py)::int + 1 left join r d on d.x = floor(px)::int + 1 and d.y = floor(py)::int + 1)
select id, case when v0 is not null and v1 is not null and v2 is not null and v3 is not null then trunc((v0 * (1 - (px - floor(px))) + v1 * (px - floor(px))) * (1 - (py - floor(py))) + (v2 * (1 - (px - floor(px))) + v3 * (px - floor(px))) * (py - floor(py)) + 0.5e0)::int else coalesce(v0, v1, v2, v3) end as value from v""",
)
def bilinear_samples(spark: SparkSession, folder: str) -> DataFrame:
    points = customers(spark, folder).select("id", ((F.col("lon") + 180) / 360.0 * 62).alias("px"), ((F.col("lat") + 90) / 180.0 * 62).alias("py"))
    return raster.bilinear(points, pixels(spark, folder).where("raster = 1 and band = 0"), 0)


_TILES = f"(select s_suppkey as tile, {LON_SQL.format(k='s_suppkey')} - 15 as west, {LAT_SQL.format(k='s_suppkey')} - 15 as south, {LON_SQL.format(k='s_suppkey')} + 15 as east, {LAT_SQL.format(k='s_suppkey')} + 15 as north, case when s_suppkey % 3 <> 0 then (s_suppkey * 17 % 1000)::int end as value from supplier)"


def mosaic(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    x, y = longitude(s), latitude(s)
    return table(spark, folder, "supplier").select(s.alias("tile"), (x - 15).alias("west"), (y - 15).alias("south"), (x + 15).alias("east"), (y + 15).alias("north"), F.when(s % 3 != 0, s * 17 % 1000).cast("int").alias("value"))


@query("mosaic_samples", f"select id, arg_min(value, tile) as value, min(tile) as tile from {CUSTOMERS_SQL} join {_TILES} on lon between west and east and lat between south and north where value is not null group by id")
def mosaic_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The value of the first tile of a mosaic, in order of insertion, that holds each point."""
    return raster.first_valid(customers(spark, folder).select("id", "lon", "lat"), mosaic(spark, folder), 10.0)


@query("mosaic_extent", f"select min(west) as west, min(south) as south, max(east) as east, max(north) as north, round(avg(east - west), 6) as mean_width, greatest(1, least(1024, round((max(east) - min(west)) / (avg(east - west) / 2))))::int as buckets from {_TILES}")
def mosaic_extent(spark: SparkSession, folder: str) -> DataFrame:
    width = F.avg(F.col("east") - F.col("west"))
    buckets = F.greatest(F.lit(1.0), F.least(F.lit(1024.0), F.round((F.max("east") - F.min("west")) / (width / 2))))
    return mosaic(spark, folder).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"), F.round(width, 6).alias("mean_width"), buckets.cast("int").alias("buckets"))


@query("mosaic_spacing", f"with b as (select id, lon - 2 as w, lon + 2 as e, lat - 2 as s, lat + 2 as n from {CUSTOMERS_SQL}) select id, min(30.0e0 / (100 + tile % 50)) as spacing from b join {_TILES} on w < east and e > west and s < north and n > south group by id")
def mosaic_spacing(spark: SparkSession, folder: str) -> DataFrame:
    """The finest sample spacing of the tiles that overlap each box."""
    asks = customers(spark, folder).select("id", "lon", "lat", (F.col("lon") - 2).alias("w"), (F.col("lon") + 2).alias("e"), (F.col("lat") - 2).alias("s"), (F.col("lat") + 2).alias("n"))
    spacing = 30.0 / (100 + F.col("tile") % 50)
    sides = {"west": -1, "south": -1, "east": 1, "north": 1}
    wide = mosaic(spark, folder).select("tile", spacing.alias("spacing"), *(F.col(c).alias(f"tile_{c}") for c in sides), *((F.col(c) + sign * 2.001).alias(c) for c, sign in sides.items()))
    # a box overlaps a tile if its centre lies in the tile grown by two degrees
    bounds = lambda *at: (covering.inside(*at, within=0.002), F.col("spacing"), F.col("spacing"))
    hit = covering.candidates(asks, wide, "tile", 8.0, 3, bounds, ties=False).where("w < tile_east and e > tile_west and s < tile_north and n > tile_south")
    return hit.groupBy("id").agg(F.min("spacing").alias("spacing"))


@query("tile_coverage", f"select tile, x::int as x, y::int as y from (select tile, unnest(range(greatest(floor((west + 180) / 11.25e0), 0)::int, least(ceil((east + 180) / 11.25e0), 31)::int + 1)) as x, s, n from (select *, greatest(floor((south + 90) / 11.25e0), 0)::int as s, least(ceil((north + 90) / 11.25e0), 15)::int as n from {_TILES})), (select unnest(range(0, 16)) as y) where y between s and n")
def tile_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """The quads of a level that each tile of a mosaic covers."""

    def span(lo: str, hi: str, base: int, top: int):
        a = F.greatest(F.floor((F.col(lo) + base) / 11.25), F.lit(0)).cast("int")
        b = F.least(F.ceil((F.col(hi) + base) / 11.25), F.lit(top)).cast("int")
        return F.explode(F.sequence(a, b))

    rows = mosaic(spark, folder).withColumn("x", span("west", "east", 180, 31))
    return rows.withColumn("y", span("south", "north", 90, 15)).select("tile", "x", "y")


@query("magnified", f"select x * 4 + dx as x, y * 4 + dy as y, value from {PIXELS_SQL}, (select unnest(range(4))::int as dx), (select unnest(range(4))::int as dy) where raster = 1 and band = 0 and x < 16 and y < 16")
def magnified(spark: SparkSession, folder: str) -> DataFrame:
    """A crop of a raster enlarged four times, by the nearest pixel."""
    crop = pixels(spark, folder).where("raster = 1 and band = 0 and x < 16 and y < 16")
    steps = F.sequence(F.lit(0), F.lit(3))
    return crop.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select((F.col("x") * 4 + F.col("dx")).alias("x"), (F.col("y") * 4 + F.col("dy")).alias("y"), "value")


@query("blended", f"with a as (select x, y, band, value, ((x * 7 + y) % 256) / 255.0e0 as alpha from {PIXELS_SQL} where raster = 1), b as (select x, y, band, value, ((x + y * 3) % 256) / 255.0e0 as alpha from {PIXELS_SQL} where raster = 2) select x, y, band, round(a.value * (1 - b.alpha) + b.value * b.alpha, 6) as value, round(1 - (1 - a.alpha) * (1 - b.alpha), 9) as alpha from a join b using (x, y, band)")
def blended(spark: SparkSession, folder: str) -> DataFrame:
    """One raster over another: colours by the upper alpha, alphas by complements."""
    rows = pixels(spark, folder)
    a = rows.where("raster = 1").select("x", "y", "band", F.col("value").alias("v"), ((F.col("x") * 7 + F.col("y")) % 256 / 255.0).alias("p"))
    b = rows.where("raster = 2").select("x", "y", "band", F.col("value").alias("w"), ((F.col("x") + F.col("y") * 3) % 256 / 255.0).alias("q"))
    return a.join(b, ["x", "y", "band"]).select("x", "y", "band", F.round(F.col("v") * (1 - F.col("q")) + F.col("w") * F.col("q"), 6).alias("value"), F.round(1 - (1 - F.col("p")) * (1 - F.col("q")), 9).alias("alpha"))


@query("array_quality", f"with d as (select a.raster, a.value as v, a.value - b.value as e from {PIXELS_SQL} a join {PIXELS_SQL} b on b.raster = 1 and a.x = b.x and a.y = b.y and a.band = b.band where a.raster > 1) select raster, max(v) as top, min(v) as low, max(abs(v)) as amax, sum(v * v)::bigint as energy, round(avg(v), 9) as mean, max(abs(e)) as amax_difference, round(sqrt(avg(e * e)), 9) as rms, round(20 * log10(max(abs(v)) / sqrt(avg(e * e))), 9) as psnr, round(avg((abs(e) <= 2)::int), 9) as zeros from d group by raster")
def array_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Reductions of rasters, and how far they are from the first."""
    rows = pixels(spark, folder)
    base = rows.where("raster = 1").select("x", "y", "band", F.col("value").alias("b"))
    d = rows.where("raster > 1").join(base, ["x", "y", "band"]).select("raster", F.col("value").alias("v"), (F.col("value") - F.col("b")).alias("e"))
    rms = F.sqrt(F.avg(F.col("e") * F.col("e")))
    return d.groupBy("raster").agg(
        F.max("v").alias("top"), F.min("v").alias("low"), F.max(F.abs("v")).alias("amax"), F.sum((F.col("v") * F.col("v")).cast("long")).alias("energy"), F.round(F.avg("v"), 9).alias("mean"),
        F.max(F.abs("e")).alias("amax_difference"), F.round(rms, 9).alias("rms"), F.round(20 * F.log10(F.max(F.abs("v")) / rms), 9).alias("psnr"), F.round(F.avg((F.abs("e") <= 2).cast("int")), 9).alias("zeros"),
    )
