"""What the corpus operators share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is
    unset (tests in local mode) a temporary folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tilewright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Folders of tables that this Python process has saved and not removed.
_folders: list[str] = []


def saved(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, and a
    lost executor costs no recomputation of what lies before.

    The folder is noted in ``scratch`` for those who ``remove`` it once nothing
    reads it any more, else until ``clear_saved``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    (_folders if scratch is None else scratch).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of saved tables, and empties the list."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    folders.clear()


def clear_saved(spark: SparkSession) -> None:
    """Deletes what the operators have left in the shared folder.  To be called
    when all their results are written: DataFrames that they gave read from it."""
    remove(spark, _folders)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``most`` bytes of ``column``
    (a single longer row stays whole), which bounds what a kernel holds at once."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
