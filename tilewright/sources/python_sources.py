"""Sources in Python that Spark plans like its own: they cut their reading into
partitions and take filters, so what is filtered away is never read.

Filters are handed down only where ``spark.sql.python.filterPushdown.enabled`` is set,
as :func:`register` does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains, StringStartsWith
from pyspark.sql.types import StructType

#: Degrees of a cell of a stored gazetteer.
CELL = 30.0
_FIELDS = "id long, lon double, lat double, name string, folded string, class string"
_RANGES = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)


def write_gazetteer(places: DataFrame, path: str) -> None:
    """Stores places (id, lon, lat, name, class) by cells of the map, with their folded names."""
    cell = [F.floor(F.col(c) / CELL).cast("int").alias(f"cell_{c}") for c in ("lon", "lat")]
    rows = places.select("id", "lon", "lat", "name", F.lower("name").alias("folded"), "class", *cell)
    rows.repartition("cell_lon", "cell_lat").write.mode("overwrite").partitionBy("cell_lon", "cell_lat").parquet(path)


@dataclass
class Cell(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        self.files = files


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path, whatever its scheme's name in Hadoop."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://").replace("file:///", "file:/").replace("file:/", "file:///"))


def _as_expression(f: Filter) -> pc.Expression:
    column, value = pc.field(f.attribute[0]), f.value
    if isinstance(f, StringContains):
        return pc.match_substring(column, value)
    if isinstance(f, StringStartsWith):
        return pc.starts_with(column, value)
    return {GreaterThan: column > value, GreaterThanOrEqual: column >= value, LessThan: column < value, LessThanOrEqual: column <= value, EqualTo: column == value}[type(f)]


class GazetteerReader(DataSourceReader):
    """One partition a cell; cells outside the filters' box are left out, and within the
    others Parquet skips what statistics rule out."""

    def __init__(self, path: str):
        self.path = path
        self.taken: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            ranged = isinstance(f, _RANGES) and f.attribute in (("lon",), ("lat",))
            named = isinstance(f, (EqualTo, StringContains, StringStartsWith)) and f.attribute in (("name",), ("folded",), ("class",))
            if ranged or named:
                self.taken.append(f)
            else:
                yield f

    def cells(self) -> dict[str, tuple[float, float]]:
        """The closed range of each axis that filters leave."""
        out = {"lon": (-math.inf, math.inf), "lat": (-math.inf, math.inf)}
        for f in self.taken:
            axis = f.attribute[0]
            if axis in out:
                low, high = out[axis]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = max(low, math.nextafter(f.value, math.inf) if isinstance(f, GreaterThan) else f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = min(high, math.nextafter(f.value, -math.inf) if isinstance(f, LessThan) else f.value)
                out[axis] = (low, high)
        return out

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _files(self.path)
        found = ds.dataset(root, filesystem=store, partitioning=ds.partitioning(flavor="hive"), format="parquet", exclude_invalid_files=False)
        box, by = self.cells(), {}
        for fragment in found.get_fragments():
            keys = ds.get_partition_keys(fragment.partition_expression)
            at = [(int(keys[f"cell_{c}"]) * CELL, (int(keys[f"cell_{c}"]) + 1) * CELL) for c in ("lon", "lat")]
            if all(first <= high and low < end for (low, high), (first, end) in zip(box.values(), at, strict=True)):
                by.setdefault((keys["cell_lon"], keys["cell_lat"]), []).append(fragment.path)
        return [Cell(files) for files in by.values()] or [Cell([])]

    def read(self, partition: Cell) -> Iterator[pa.RecordBatch]:
        store, _ = _files(self.path)
        where = None
        for f in self.taken:
            where = _as_expression(f) if where is None else where & _as_expression(f)
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        if partition.files:
            yield from ds.dataset(partition.files, filesystem=store, format="parquet").to_batches(columns=names, filter=where)


class Gazetteer(DataSource):
    """``spark.read.format("gazetteer").load(path)`` of what :func:`write_gazetteer` wrote."""

    @classmethod
    def name(cls) -> str:
        return "gazetteer"

    def schema(self) -> str:
        return _FIELDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return GazetteerReader(self.options["path"])


@dataclass
class Band(InputPartition):
    first: int
    end: int

    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class CallbackReader(DataSourceReader):
    """Rows of a grid in bands; only columns and rows within the filters are computed."""

    def __init__(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, height: int, band: int):
        self.f, self.width, self.height, self.band = f, width, height, band
        self.x, self.y = (0, width), (0, height)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not isinstance(f, _RANGES) or f.attribute not in (("x",), ("y",)):
                yield f
                continue
            low, end = getattr(self, f.attribute[0])
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                low = max(low, math.floor(f.value) + 1 if isinstance(f, GreaterThan) else math.ceil(f.value))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                end = min(end, math.ceil(f.value) if isinstance(f, LessThan) else math.floor(f.value) + 1)
            setattr(self, f.attribute[0], (low, max(low, end)))

    def partitions(self) -> Sequence[InputPartition]:
        return [Band(a, min(a + self.band, self.y[1])) for a in range(self.y[0], self.y[1], self.band)] or [Band(0, 0)]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        columns = np.arange(*self.x, dtype=np.int32)
        for y in range(partition.first, partition.end):
            u, v = columns / max(self.width - 1, 1), np.full(len(columns), y / max(self.height - 1, 1))
            values = np.asarray(self.f(u, v), float)
            yield pa.RecordBatch.from_arrays([pa.array(columns), pa.array(np.full(len(columns), y, np.int32)), pa.array(u), pa.array(v), pa.array(values)], names=["x", "y", "u", "v", "value"])


def callback_source(spark: SparkSession, name: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> str:
    """Registers a user's function of (u, v) in 0 to 1, over arrays, as a raster source
    (x, y, u, v, value); options width, height and band (rows a partition)."""

    class Callback(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "x int, y int, u double, v double, value double"

        def reader(self, schema: StructType) -> DataSourceReader:
            return CallbackReader(f, int(self.options["width"]), int(self.options["height"]), int(self.options.get("band", 64)))

    register(spark)
    spark.dataSource.register(Callback)
    return name


def register(spark: SparkSession) -> None:
    """Makes the gazetteer source known, and lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Gazetteer)


def sample_callback(points: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Points (u, v and others) with ``value`` by a user's function; null outside 0 to 1."""

    @F.pandas_udf("double")
    def sampled(u, v):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.asarray(f(u.to_numpy(), v.to_numpy()), float))

    inside = F.col("u").between(0, 1) & F.col("v").between(0, 1)
    return points.withColumn("value", F.when(inside, sampled(F.col("u"), F.col("v"))))
