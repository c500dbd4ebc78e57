"""Queries of warped rasters: a source a supplier, its pixels the line items'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.operators import warp
from tilewright.sources.tables import LAT_SQL, LON_SQL, latitude, longitude, table

_WIDTH, _HEIGHT, _BLOCK, _PIXELS, _LEVELS, _LEAST = 24, 20, 8, 32, 3, 20


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Of each supplier a raster of one or three bands, coarse or fine, some of them sheared."""
    s = F.col("s_suppkey")
    step = F.when(s % 2 == 0, 1.5).otherwise(0.75)
    rows = table(spark, folder, "supplier").select(s.cast("long").alias("raster"), F.lit(_WIDTH).alias("width"), F.lit(_HEIGHT).alias("height"), F.when(s % 3 == 0, 1).otherwise(3).alias("bands"), step.alias("step"), longitude(s).alias("x0"), latitude(s).alias("y0"), (s % 4 / F.lit(10.0)).alias("shear"))
    affine = {"x_col": F.col("step"), "x_row": F.col("shear") * F.col("step"), "y_col": F.col("shear") * F.col("step") / 2, "y_row": -F.col("step")}
    return rows.withColumns(affine).withColumn("level", warp.level_for(F.col("step"), _PIXELS, _LEVELS)).drop("step", "shear")


def source_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(raster, x, y, band, value) of the sources; some places have no pixel."""
    i = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("long").alias("raster"), (F.col("l_partkey") * 13 % _WIDTH).cast("int").alias("x"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % _HEIGHT).cast("int").alias("y"), F.col("l_orderkey").alias("k"))
    bands = F.when(F.col("raster") % 3 == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(2)))
    rows = i.withColumn("band", F.explode(bands))
    return rows.groupBy("raster", "x", "y", "band").agg(F.max((F.col("k") * 31 + F.col("band") * 50) % 256).cast("int").alias("value"))


_PIXELS_SQL = f"""px as (select raster, x, y, band, max((k * 31 + band * 50) % 256)::int as value from (
  select l_suppkey::bigint as raster, (l_partkey * 13 % {_WIDTH})::int as x, ((l_orderkey * 7 + l_linenumber) % {_HEIGHT})::int as y, l_orderkey as k from lineitem), (select unnest(range(3))::int as band)
  where band = 0 or raster % 3 <> 0 group by all)"""


@query(
    "raster_blocks",
    f"""with {_PIXELS_SQL}, owned as (select *, unnest(case when x % {_BLOCK} = 0 and x > 0 then [x // {_BLOCK}, x // {_BLOCK} - 1] else [x // {_BLOCK}] end) as bx from px),
halo as (select *, unnest(case when y % {_BLOCK} = 0 and y > 0 then [y // {_BLOCK}, y // {_BLOCK} - 1] else [y // {_BLOCK}] end) as "by" from owned)
select raster, bx::int as bx, "by"::int as "by", band, count(*)::int as pixels, sum(value * (1 + (y - "by" * {_BLOCK}) * {_BLOCK + 1} + x - bx * {_BLOCK}))::bigint as weighed from halo group by raster, bx, "by", band""",
)
def raster_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each block of each source with its neighbours' first column and row, as counts and weighed sums."""
    rows = warp.blocks(source_pixels(spark, folder), _BLOCK)
    weighed = F.aggregate(F.zip_with("places", "values", lambda p, v: (v * (1 + p)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return rows.select("raster", "bx", "by", "band", F.size("places").alias("pixels"), weighed.alias("weighed"))


_STEP = f"(180.0e0 / (1 << level) / {_PIXELS})"
_NEIGHBOURS = [(0, 0), (1, 0), (0, 1), (1, 1)]
_WEIGHT = {(a, b): f"(({'fx' if a else '1 - fx'}) * ({'fy' if b else '1 - fy'}))" for a, b in _NEIGHBOURS}
_SUM = " + ".join(f"coalesce({_WEIGHT[a, b]} * p{a}{b}.value, 0)" for a, b in _NEIGHBOURS)
_KNOWN = " + ".join(f"case when p{a}{b}.value is not null then {_WEIGHT[a, b]} else 0 end" for a, b in _NEIGHBOURS)
_JOINS = " ".join(f"left join px p{a}{b} on p{a}{b}.raster = d.raster and p{a}{b}.band = d.band and p{a}{b}.x = i + {a} and p{a}{b}.y = j + {b}" for a, b in _NEIGHBOURS)


@query(
    "warped_quads",
    f"""with {_PIXELS_SQL},
s as (select s_suppkey::bigint as raster, case when s_suppkey % 2 = 0 then 1.5e0 else 0.75e0 end as step, {LON_SQL.format(k='s_suppkey')} as x0, {LAT_SQL.format(k='s_suppkey')} as y0, s_suppkey % 4 / 10.0e0 as shear from supplier),
m as (select raster, x0, y0, step as ax, shear * step as ay, shear * step / 2 as bx, -step as "by", ({' + '.join(f'(180.0e0 / {1 << v} / {_PIXELS} > step)::int' for v in range(_LEVELS))}) as level from s),
box as (select *, least(0, ay * {_HEIGHT}) + x0 as west, x0 + ax * {_WIDTH} + greatest(0, ay * {_HEIGHT}) as east, y0 + "by" * {_HEIGHT} as south, y0 + bx * {_WIDTH} as north from m),
cols as (select *, unnest(range(greatest(0, floor((west + 180) / {_STEP})::int - 1), least(2 * {_PIXELS} << level, ceil((east + 180) / {_STEP})::int + 1))) as x from box),
dest as (select *, unnest(range(greatest(0, floor((90 - north) / {_STEP})::int - 1), least({_PIXELS} << level, ceil((90 - south) / {_STEP})::int + 1))) as y from cols),
world as (select *, (x + 0.5e0) * {_STEP} - 180 as lon, 90 - (y + 0.5e0) * {_STEP} as lat, ax * "by" - ay * bx as det from dest),
back as (select *, ((lon - x0) * "by" - (lat - y0) * ay) / det as u, ((lat - y0) * ax - (lon - x0) * bx) / det as v from world),
d as (select raster, level, x, y, floor(u - 0.5e0)::int as i, floor(v - 0.5e0)::int as j, u - 0.5e0 - floor(u - 0.5e0) as fx, v - 0.5e0 - floor(v - 0.5e0) as fy, band from back, (select unnest(range(3))::int as band) where u >= 0 and u < {_WIDTH} and v >= 0 and v < {_HEIGHT} and (band = 0 or raster % 3 <> 0)),
w as (select d.raster, level, d.x, d.y, d.band, ({_SUM}) as total, ({_KNOWN}) as weight from d {_JOINS}),
values1 as (select raster, level, x, y, band, floor(total / weight + 0.5e0)::int as value from w where weight > 1e-5),
every as (select raster, level, x, y, unnest(case when raster % 3 = 0 then [0, 1, 2] else [band] end)::int as band, value from values1),
bands as (select raster, level, x, y, list(value order by band) as vs from every group by raster, level, x, y),
best as (select level, x, y, arg_max(vs, raster) filter (list_sum(vs) >= {_LEAST} * len(vs)) as vs, max(len(vs)) as n from bands group by level, x, y)
select level::int as level, (x // {_PIXELS})::int as quad_x, (y // {_PIXELS})::int as quad_y, (x % {_PIXELS})::int as x, (y % {_PIXELS})::int as y, band::int as band, coalesce(vs[band + 1], 0)::int as value from best, (select unnest(range(3)) as band) where band < n""",
)
def warped_quads(spark: SparkSession, folder: str) -> DataFrame:
    """All sources warped into the quads of their level, the last one on top."""
    rows = warp.last_pixels(sources(spark, folder), warp.banded_blocks(source_pixels(spark, folder), _BLOCK), _PIXELS, _LEAST, size=_BLOCK)
    return warp.in_quads(rows, _PIXELS)
