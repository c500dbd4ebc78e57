"""A log of the quads that a stream has written, one entry a quad and batch, however
often a batch is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["level", "x", "y"]


def written(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: puts a batch's quads (level, x, y and others) under
    ``folder/quads`` and their keys under ``folder/log``.

    Each batch has a partition of its own, which a second try overwrites; the log comes
    last, so it names no quad that isn't there."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        for name, part in (("quads", rows), ("log", rows.groupBy(*KEY).agg(F.count("*").alias("pixels")))):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        rows.unpersist()

    return put


def run(stream: DataFrame, folder: str) -> None:
    """Works off what is there now, in batches."""
    query = stream.writeStream.foreachBatch(written(folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(level, x, y, batch, pixels) of the log."""
    return spark.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log")


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(level, x, y, batch, writes): the last batch that wrote a quad, and how many did."""
    return entries(spark, folder).groupBy(*KEY).agg(F.max("batch").alias("batch"), F.count("*").alias("writes"))
