"""Queries over sources in Python, users' functions, and a stream's change log."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions import tiles
from tilewright.operators import loops, neighbours, ranks
from tilewright.sources import python_sources
from tilewright.sources.tables import CUSTOMERS_SQL, LAT_SQL, LON_SQL, PARTS_SQL, PIXELS_SQL, customers, latitude, longitude, parts, pixels, table
from tilewright.streaming import change_log

_PAGE = 25
#: Descriptions of classes of places; others have none.
_CLASSES = {"STANDARD": "a usual place", "SMALL": "a hamlet", "LARGE": "a town", "PROMO": "a sight"}


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where checkpoints go, which all executors share."""
    loops.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(
    "gazetteer_pages",
    f"""with p as (select q.id, lon, lat, p_name as name, p_type as class from {PARTS_SQL} q join part on p_partkey = id),
f as (select * from p where lower(name) like '%in%' and lon >= -90 and lon < 140.5 and lat > -45 and lat <= 80)
select id, name, lon, lat, case class {' '.join(f"when '{k}' then '{v}'" for k, v in _CLASSES.items())} else 'description missing' end as description, ((row_number() over (order by name, id) - 1) // {_PAGE})::bigint as page from f""",
)
def gazetteer_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Places of a box whose names hold a text, in pages, from a stored gazetteer that
    itself leaves out other cells and names."""
    place = parts(spark, folder).select("id", "lon", "lat")
    named = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("class"))
    path = _folder(spark, "gazetteer")
    python_sources.write_gazetteer(place.join(named, "id"), path)
    python_sources.register(spark)
    found = spark.read.format("gazetteer").load(path).where("contains(folded, 'in') and lon >= -90 and lon < 140.5 and lat > -45 and lat <= 80")
    described = F.coalesce(F.create_map(*(F.lit(v) for pair in _CLASSES.items() for v in pair))[F.col("class")], F.lit("description missing"))
    rows = ranks.placed(found.select("id", "name", "lon", "lat", described.alias("description")), [], ["name", "id"])
    return rows.select("id", "name", "lon", "lat", "description", F.floor((F.col("place") - 1) / _PAGE).alias("page"))


def hills(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A user's elevation."""
    return 100 * u + 50 * v * v - 30 * u * v


_HILLS = "(100 * {u} + 50 * {v} * {v} - 30 * {u} * {v})"


@query("callback_residuals", f"select raster, x, y, band, round(value - {_HILLS.format(u='(x / 63.0e0)', v='(y / 63.0e0)')}, 6) as residual from {PIXELS_SQL} where y >= 8")
def callback_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels against a raster that a user's function gives, without its first eight rows."""
    source = python_sources.callback_source(spark, "hills", hills)
    base = spark.read.format(source).option("width", 64).option("height", 64).option("band", 16).load().where("y >= 8").select("x", "y", F.col("value").alias("base"))
    return pixels(spark, folder).join(base, ["x", "y"]).select("raster", "x", "y", "band", F.round(F.col("value") - F.col("base"), 6).alias("residual"))


@query("callback_samples", f"with p as (select id, (lon + 170) / 340.0e0 as u, (lat + 90) / 180.0e0 as v from {CUSTOMERS_SQL}) select id, case when u between 0 and 1 and v between 0 and 1 then round({_HILLS.format(u='u', v='v')}, 6) end as value from p")
def callback_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A user's elevation at each customer; none outside its domain."""
    points = customers(spark, folder).select("id", ((F.col("lon") + 170) / 340.0).alias("u"), ((F.col("lat") + 90) / 180.0).alias("v"))
    return python_sources.sample_callback(points, hills).select("id", F.round("value", 6).alias("value"))


@query(
    "nearest_of_a_kind",
    f"""with s as (select s_suppkey as sid, s_nationkey as nation, {LON_SQL.format(k='s_suppkey')} as slon, {LAT_SQL.format(k='s_suppkey')} as slat from supplier),
d as (select sid, c.id, (lon - slon) * (lon - slon) + (lat - slat) * (lat - slat) as d2 from s, {CUSTOMERS_SQL} c join customer on c_custkey = c.id where c_nationkey <> nation and c_acctbal > 0)
select sid, id, d2, row_number() over (partition by sid order by d2, id)::int as place from d where d2 < 900 qualify place <= 3""",
)
def nearest_of_a_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest customers of each supplier that aren't of its nation and owe nothing."""
    s = F.col("s_suppkey")
    ask = table(spark, folder, "supplier").select(s.alias("sid"), "s_nationkey", longitude(s).alias("x"), latitude(s).alias("y"))
    more = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_acctbal")
    points = customers(spark, folder).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")).join(more, "id")
    return neighbours.nearest(ask, points, "sid", "id", k=3, radius=30.0, accept=lambda q, p: (q("s_nationkey") != p("c_nationkey")) & (p("c_acctbal") > 0)).withColumnRenamed("rank", "place")


@query(
    "written_quads",
    f"with c as (select l_orderkey * 8 + l_linenumber as k from lineitem), p as (select {LON_SQL.format(k='k')} as lon, {LAT_SQL.format(k='k')} as lat from c) select 4 as level, least(floor((lon + 180) / 11.25e0)::int, 31) as x, 15 - least(floor((lat + 90) / 11.25e0)::int, 15) as y, count(*) as pixels from p group by all",
)
def written_quads(spark: SparkSession, folder: str) -> DataFrame:
    """The change log of a stream that writes each line item into its quad of level 4."""
    schema = table(spark, folder, "lineitem").schema
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    row, col = tiles.point_tile(F.col("lon"), F.col("lat"), 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/lineitem*")
    stream = stream.select(longitude(k).alias("lon"), latitude(k).alias("lat")).select(F.lit(4).alias("level"), col.alias("x"), row.alias("y"), "lon", "lat")
    log = _folder(spark, "quads")
    change_log.run(stream, log)
    return change_log.entries(spark, log).groupBy(*change_log.KEY).agg(F.sum("pixels").alias("pixels"))
