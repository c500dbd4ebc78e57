"""Queries of hierarchy building: what must be refined, and checks of stored names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.plans.raster import _TILES, mosaic
from tilewright.sources.tables import TILES_SQL
from tilewright.sources.tables import tiles as tile_table

_MOST, _SAMPLES = 7, 64


@query(
    "built_nodes",
    f"""with t as (select tile, greatest(west, -180.0e0) as west, greatest(south, -90.0e0) as south, least(east, 179.999e0) as east, least(north, 90.0e0) as north, 0.02e0 + (tile % 10) / 20.0e0 as spacing from {_TILES}),
n as (select t.*, l from t, (select unnest(range({_MOST} + 1))::int as l) where l = 0 or 90.0e0 / {_SAMPLES} / (1 << (l - 1)) > spacing),
c as (select l as level, x::int as col, y::int as row from (select *, unnest(range(floor((west + 180) / (90.0e0 / (1 << l)))::int, floor((east + 180) / (90.0e0 / (1 << l)))::int + 1)) as x from n), (select unnest(range(0, 2 << {_MOST})) as y) where y between floor((90 - north) / (90.0e0 / (1 << l)))::int and least(floor((90 - south) / (90.0e0 / (1 << l)))::int, (2 << l) - 1))
select level, count(*) as nodes from (select distinct level, row, col from c) group by level""",
)
def built_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of a hierarchy that is split wherever a source is finer than a node's
    spacing.  Spacing halves with each level, so each source asks for a known range of
    levels, and its boxes are cut into nodes of all of them at once."""
    t = mosaic(spark, folder).select(F.greatest("west", F.lit(-180.0)).alias("west"), F.greatest("south", F.lit(-90.0)).alias("south"), F.least("east", F.lit(179.999)).alias("east"), F.least("north", F.lit(90.0)).alias("north"), (0.02 + (F.col("tile") % 10) / 20.0).alias("spacing"))
    rows = t.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_MOST))))
    rows = rows.where((F.col("level") == 0) | (90.0 / _SAMPLES / F.pow(F.lit(2.0), F.col("level") - 1) > F.col("spacing")))
    size = 90.0 / F.pow(F.lit(2.0), "level")
    last = F.call_function("shiftleft", F.lit(2), F.col("level")) - 1
    cols = F.sequence(F.floor((F.col("west") + 180) / size).cast("int"), F.floor((F.col("east") + 180) / size).cast("int"))
    lines = F.sequence(F.floor((90 - F.col("north")) / size).cast("int"), F.least(F.floor((90 - F.col("south")) / size).cast("int"), last))
    nodes = rows.withColumn("col", F.explode(cols)).withColumn("row", F.explode(lines)).select("level", "row", "col").distinct()
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"))


_NAMES = f"(select id, 'tiles/' || case when id % 21 = 0 then level + 20 else level end || '/' || case when id % 17 = 0 then row + 5000 else row end || '/' || case when id % 13 = 0 then 'x' else '' end || col || '_' || row || '.png' as name from {TILES_SQL})"


@query(
    "damaged_names",
    f"""with p as (select id, regexp_extract(name, '^tiles/([0-9]+)/([0-9]+)/([0-9]+)_([0-9]+)\\.png$', ['level', 'row', 'x', 'y']) as m from {_NAMES}),
q as (select id, try_cast(m.level as int) as level, try_cast(m.row as int) as row, try_cast(m.x as int) as x, try_cast(m.y as int) as y from p)
select id, case when level is null then 'name' when level > 17 then 'level' when row <> y then 'row' when x >= (4 << level) or y >= (2 << level) then 'range' else 'ok' end as status from q""",
)
def damaged_names(spark: SparkSession, folder: str) -> DataFrame:
    """Stored tile names checked: form, level, that the row folder is the row, and range."""
    t = tile_table(spark, folder)
    i = F.col("id")
    name = F.concat(F.lit("tiles/"), F.when(i % 21 == 0, F.col("level") + 20).otherwise(F.col("level")), F.lit("/"), F.when(i % 17 == 0, F.col("row") + 5000).otherwise(F.col("row")), F.lit("/"), F.when(i % 13 == 0, "x").otherwise(""), F.col("col"), F.lit("_"), F.col("row"), F.lit(".png"))
    form = r"^tiles/([0-9]+)/([0-9]+)/([0-9]+)_([0-9]+)\.png$"
    q = t.select("id", *[F.regexp_extract(name, form, g).try_cast("int").alias(n) for g, n in enumerate(("level", "row", "x", "y"), 1)])
    fine = F.least(F.col("level"), F.lit(17))
    outside = (F.col("x") >= F.call_function("shiftleft", F.lit(4), fine)) | (F.col("y") >= F.call_function("shiftleft", F.lit(2), fine))
    return q.select("id", F.when(F.col("level").isNull(), "name").when(F.col("level") > 17, "level").when(F.col("row") != F.col("y"), "row").when(outside, "range").otherwise("ok").alias("status"))


@query("tile_extents", f"select tile, west, south, east, north, (east - west) * (north - south) as area, west < -180 or east > 180 or south < -90 or north > 90 as beyond from {_TILES}")
def tile_extents(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of source tiles, their areas, and which reach beyond the world."""
    beyond = (F.col("west") < -180) | (F.col("east") > 180) | (F.col("south") < -90) | (F.col("north") > 90)
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    return mosaic(spark, folder).select("tile", "west", "south", "east", "north", area.alias("area"), beyond.alias("beyond"))
