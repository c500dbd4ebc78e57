"""Structured Streaming forms of the telemetry queries: the same results, kept up
to date over files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 16) -> DataFrame:
    """A stream of event files (Parquet) of a folder, with ``ts`` as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_timings(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, maximum and slow samples of each type by windows of event time;
    state older than the watermark is dropped."""
    fine = events.where("value is not null and not isnan(value) and value >= 0").withWatermark("ts", late)
    grouped = fine.groupBy(F.window("ts", window), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("maximum"), F.count_if(F.col("value") > 50).alias("over_50"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "maximum", "over_50")


def fresh_requests(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (user, type, value) once within the watermark: shared requests are sent once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type", "value"])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what is there now, in batches, into a Parquet table."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
