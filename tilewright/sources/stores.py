"""Sources and sinks: record stores ordered by Morton code, tile trees, mosaics, gazetteers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.grid import morton


def write_records(records: DataFrame, path: str, files: int) -> None:
    """Stores (kind, i, j, k, payload) so that near keys share files and row groups:
    ranges of Morton codes by file, sorted within, which lets a read skip files."""
    high, low = morton(F.col("i"), F.col("j"), F.col("k"))
    rows = records.withColumn("high", high).withColumn("low", low)
    rows.repartitionByRange(files, "kind", "high", "low").sortWithinPartitions("kind", "high", "low").write.mode("overwrite").parquet(path)


def read_record(spark: SparkSession, path: str, kind: int, i: int, j: int, k: int) -> DataFrame:
    """One record; the filters reach the file scan."""
    return spark.read.parquet(path).where((F.col("kind") == kind) & (F.col("i") == i) & (F.col("j") == j) & (F.col("k") == k)).select("kind", "i", "j", "k", "payload")


def fetch_records(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests (kind, i, j, k) with their payloads; each key is looked up once."""
    keys = ["kind", "i", "j", "k"]
    found = requests.select(*keys).distinct().join(store.select(*keys, "payload"), keys, "left")
    return requests.join(found, keys, "left")


def replace_records(store: DataFrame, changed: DataFrame) -> DataFrame:
    """A store with changed records put in place of old ones; a null payload removes."""
    keys = ["kind", "i", "j", "k"]
    kept = store.join(changed.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*keys, "payload").unionByName(changed.where(F.col("payload").isNotNull()).select(*keys, "payload"))


def write_tiles(pixels: DataFrame, path: str) -> None:
    """Tiles (level, x, y, ...) in a folder for each level."""
    pixels.repartition("level").write.mode("overwrite").partitionBy("level").parquet(path)


def read_rasters(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Raw 8-bit rasters named ``name_WIDTHxHEIGHTxBANDS.raw``, as one row a file:
    (path, name, width, height, bands, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    size = [F.regexp_extract(name, r"_(\d+)x(\d+)x(\d+)\.raw$", g).try_cast("int").alias(c) for g, c in ((1, "width"), (2, "height"), (3, "bands"))]
    return files.select("path", F.regexp_extract(name, r"^(.*)_\d+x\d+x\d+\.raw$", 1).alias("name"), *size, "content")


def explode_rasters(rasters: DataFrame) -> DataFrame:
    """(name, x, y, band, value) of each byte of raw rasters."""
    n = F.octet_length("content")
    rows = rasters.where(F.col("width").isNotNull() & (n > 0)).select("name", "width", "bands", F.hex("content").alias("digits"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    pixel = F.floor(F.col("k") / F.col("bands"))
    value = F.conv(F.substring(F.col("digits"), F.col("k") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select("name", (pixel % F.col("width")).cast("int").alias("x"), F.floor(pixel / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("bands")).cast("int").alias("band"), value.alias("value"))


def read_gazetteer(spark: SparkSession, path: str, row_tag: str = "place") -> DataFrame:
    """(seq, lon, lat, elev, name, description, url) of an XML gazetteer; an unknown
    elevation is null; entries without a name are kept with an empty one."""
    schema = "id long, lon double, lat double, elev double, name string, description string, url string"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    elev = F.when(F.col("elev") != -9999, F.col("elev"))
    return rows.select(F.col("id").alias("seq"), "lon", "lat", elev.alias("elev"), F.coalesce("name", F.lit("")).alias("name"), "description", "url")
