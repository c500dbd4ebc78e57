import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringContains

from tilewright.operators import neighbours
from tilewright.sources import python_sources as ps
from tilewright.streaming import change_log


@pytest.fixture(scope="module")
def gazetteer(spark, tmp_path_factory):
    r = random.Random(1)
    rows = [(k, r.uniform(-180, 180), r.uniform(-90, 90), r.choice(["Fell", "fEn", "Spring", None]) , "c%d" % (k % 3)) for k in range(2000)] + [(5000, 30.0, 0.0, "Edge", "c0"), (5001, -180.0, -90.0, "Edge", None)]
    rows = [(i, a, b, None if n is None else f"{n} {i % 50}", c) for i, a, b, n, c in rows]
    path = str(tmp_path_factory.mktemp("places"))
    places = spark.createDataFrame(rows, "id long, lon double, lat double, name string, class string")
    ps.write_gazetteer(places, path)
    ps.register(spark)
    return path, rows


@pytest.mark.parametrize(
    ("where", "keep"),
    [
        ("lon >= 30 and lon < 61.5 and lat > -10 and lat <= 40", lambda i, a, b, n, c: 30 <= a < 61.5 and -10 < b <= 40),
        ("contains(folded, 'fe') and lat > 20", lambda i, a, b, n, c: n and "fe" in n.lower() and b > 20),
        ("folded like 'spring%' and class = 'c1'", lambda i, a, b, n, c: n and n.lower().startswith("spring") and c == "c1"),
        ("lon = 30 or id = 7", lambda i, a, b, n, c: a == 30 or i == 7),
        ("id % 2 = 0 and lon < -170", lambda i, a, b, n, c: i % 2 == 0 and a < -170),
        ("lat > 1000", lambda *r: False),
        ("name is null", lambda i, a, b, n, c: n is None),
    ],
)
def test_gazetteer(spark, gazetteer, where, keep):
    path, rows = gazetteer
    got = [tuple(r) for r in spark.read.format("gazetteer").load(path).where(where).select("id", "lon", "lat", "name", "class").collect()]
    assert sorted(got, key=lambda r: r[0]) == [r for r in sorted(rows) if keep(*r)]


def test_filters_are_in_the_plan(spark, gazetteer):
    """What the source takes isn't filtered again, what it can't take is."""
    path, _ = gazetteer

    def plan(where):
        df = spark.read.format("gazetteer").load(path).where(where)
        return df._jdf.queryExecution().executedPlan().toString()

    taken = plan("contains(folded, 'fe') and lon > 20 and lon < 50")
    assert "contains" not in taken.split("BatchScan")[0] and "> 20" not in taken.split("BatchScan")[0]
    assert "% 2" in plan("id % 2 = 1 and lon > 20").split("BatchScan")[0]


def test_cells_outside_are_not_read(gazetteer):
    path, _ = gazetteer
    reader = ps.GazetteerReader(path)
    every = len(reader.partitions())
    left = list(reader.pushFilters([GreaterThanOrEqual(("lon",), 30.0), LessThan(("lon",), 60.0), GreaterThan(("lat",), 0.0), LessThanOrEqual(("lat",), 29.0), StringContains(("folded",), "fe"), GreaterThan(("id",), 3)]))
    assert every > 70 and len(reader.partitions()) == 1
    assert left == [GreaterThan(("id",), 3)]
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in read) > 0 and all(30 <= v < 60 for b in read for v in b.column("lon").to_pylist())


def test_callback_source(spark):
    name = ps.callback_source(spark, "bowl", lambda u, v: u * u + v)
    df = spark.read.format(name).option("width", 30).option("height", 40).option("band", 7).load()
    rows = {(r["x"], r["y"]): r["value"] for r in df.collect()}
    assert rows == {(x, y): pytest.approx((x / 29) ** 2 + y / 39) for x in range(30) for y in range(40)}
    assert df.rdd.getNumPartitions() == 6
    part = df.where("y >= 10 and y < 14.5 and x > 27 and x <= 40")
    assert {(r["x"], r["y"]) for r in part.collect()} == {(x, y) for x in (28, 29) for y in range(10, 15)}
    assert part.rdd.getNumPartitions() == 1 and df.where("y > 100").count() == 0


def test_callback_reader_computes_only_what_is_asked():
    seen = []
    reader = ps.CallbackReader(lambda u, v: seen.append(len(u)) or u, 100, 50, 10)
    assert list(reader.pushFilters([GreaterThanOrEqual(("x",), 20), LessThan(("x",), 25), LessThan(("y",), 3), GreaterThan(("value",), 0.5)])) == [GreaterThan(("value",), 0.5)]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert seen == [5, 5, 5] and sum(b.num_rows for b in batches) == 15


def test_sampled_points(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.0, 1.0), (1.5, 0.0), (None, 0.2)], "u double, v double")
    assert [r["value"] for r in ps.sample_callback(df, lambda u, v: np.sqrt(u) + v).collect()] == [pytest.approx(0.5**0.5 + 0.5), 1.0, None, None]


def test_accepted_neighbours(spark):
    """The nearest that are accepted, not the accepted ones of the nearest; clashing names."""
    queries = spark.createDataFrame([(0, 0.0, 0.0, 1), (1, 5.0, 5.0, 2)], "q long, x double, y double, kind int")
    points = spark.createDataFrame([(k, k * 0.1, 0.0, k % 4) for k in range(40)], "p long, x double, y double, kind int")
    got = neighbours.nearest(queries, points, "q", "p", 3, 4.0, accept=lambda a, b: a("kind") == b("kind"))
    assert [(r["q"], r["p"]) for r in got.orderBy("q", "rank").collect()] == [(0, 1), (0, 5), (0, 9)]


def test_replayed_batches_give_one_entry(spark, tmp_path):
    folder = str(tmp_path)
    put = change_log.written(folder)
    batch = spark.createDataFrame([(2, 1, 1, 5), (2, 1, 1, 6), (2, 0, 3, 7)], "level int, x int, y int, value int")
    for number, rows in ((0, batch), (1, batch.limit(2)), (0, batch), (1, batch.limit(2)), (1, batch.limit(2))):
        put(rows, number)
    assert sorted(tuple(r) for r in change_log.entries(spark, folder).select("level", "x", "y", "batch", "pixels").collect()) == [(2, 0, 3, 0, 1), (2, 1, 1, 0, 2), (2, 1, 1, 1, 2)]
    assert sorted(tuple(r) for r in change_log.latest(spark, folder).collect()) == [(2, 0, 3, 0, 1), (2, 1, 1, 1, 2)]


def test_stream_in_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(100).select(F.lit(3).alias("level"), (F.col("id") % 7).cast("int").alias("x"), (F.col("id") % 5).cast("int").alias("y"))
    for _ in range(2):
        rows.repartition(3).write.mode("append").parquet(source)
        change_log.run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source), folder)
    log = change_log.entries(spark, folder)
    assert log.agg(F.sum("pixels")).first()[0] == 200 and log.select("batch").distinct().count() >= 3
    assert log.groupBy("level", "x", "y", "batch").count().where("count > 1").count() == 0
    assert spark.read.parquet(f"{folder}/quads").count() == 200
