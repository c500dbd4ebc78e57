"""Tables of a data folder, and points, pixels and routes derived from them.

The derivations use integer arithmetic up to the last step, so any engine gets
the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.bits import left


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def longitude(key: Column) -> Column:
    return (key * 7919 % 3600001) / F.lit(10000.0) - 180


def latitude(key: Column) -> Column:
    return (key * 104729 % 1800001) / F.lit(10000.0) - 90


#: The same in SQL, with {k} for the key.
LON_SQL = "(({k} * 7919 % 3600001) / 10000.0e0 - 180)"
LAT_SQL = "(({k} * 104729 % 1800001) / 10000.0e0 - 90)"


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """(id, lon, lat, h, name, weight) of every customer."""
    c = F.col("c_custkey")
    return table(spark, folder, "customer").select(c.alias("id"), longitude(c).alias("lon"), latitude(c).alias("lat"), (c * 37 % 9001).cast("double").alias("h"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("weight"))


CUSTOMERS_SQL = f"(select c_custkey as id, {LON_SQL.format(k='c_custkey')} as lon, {LAT_SQL.format(k='c_custkey')} as lat, (c_custkey * 37 % 9001)::double as h, c_name as name, c_acctbal as weight from customer)"


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, lon, lat, priority) of every part."""
    p = F.col("p_partkey")
    return table(spark, folder, "part").select(p.alias("id"), longitude(p).alias("lon"), latitude(p).alias("lat"), F.col("p_size").alias("priority"))


PARTS_SQL = f"(select p_partkey as id, {LON_SQL.format(k='p_partkey')} as lon, {LAT_SQL.format(k='p_partkey')} as lat, p_size as priority from part)"


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    """(id, level, row, col): one quadtree node per order, levels 0 to 9."""
    o = F.col("o_orderkey")
    level = (o % 10).cast("int")
    rows, cols = left(F.lit(2), level), left(F.lit(4), level)
    return table(spark, folder, "orders").select(o.alias("id"), level.alias("level"), (o * 31 % rows).cast("int").alias("row"), (o * 57 % cols).cast("int").alias("col"))


TILES_SQL = "(select o_orderkey as id, (o_orderkey % 10)::int as level, (o_orderkey * 31 % (2 << (o_orderkey % 10)::int))::int as row, (o_orderkey * 57 % (4 << (o_orderkey % 10)::int))::int as col from orders)"


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(raster, x, y, band, value): three-band pixels, one raster per line number,
    a pixel per line item; equal places keep the largest value."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    cell = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("raster"), (F.col("l_partkey") * 13 % 64).cast("int").alias("x"), ((F.col("l_suppkey") * 7 + F.col("l_partkey") % 5) % 64).cast("int").alias("y"), k.alias("k"))
    rows = cell.select("raster", "x", "y", "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("band"))
    return rows.groupBy("raster", "x", "y", "band").agg(F.max((F.col("x") * 31 + F.col("y") * 17 + F.col("band") * 5 + F.col("k")) % 256).cast("int").alias("value"))


PIXELS_SQL = """(select raster, x, y, band, max((x * 31 + y * 17 + band * 5 + k) % 256)::int as value from (
  select l_linenumber as raster, (l_partkey * 13 % 64)::int as x, ((l_suppkey * 7 + l_partkey % 5) % 64)::int as y, l_orderkey * 8 + l_linenumber as k from lineitem),
  (select unnest(range(3))::int as band) group by all)"""
