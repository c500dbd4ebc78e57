import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import grid, tiles
from tilewright.functions.hashing import fnv1a64
from tilewright.operators import cells, lifting, loops, neighbours, raster, replay
from tilewright.sources import stores
from tilewright.streaming import events


def test_fnv_vectors():
    assert fnv1a64([b"", b"a", b"foobar", None, b"b"]) == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", None, "af63df4c8601f1a5"]
    assert fnv1a64([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 8, 16])
def test_lifting_inverts(n):
    r = np.random.default_rng(n)
    p, q = r.integers(-10**6, 10**6, (n + 1, n + 1)), r.integers(-10**6, 10**6, (n, n))
    low, details = lifting.analyse(p, q)
    back = lifting.synthesise(low, details)
    assert (back[0] == p).all() and (back[1] == q).all()
    codes = lifting.quantise(details, 3)
    assert np.abs(lifting.dequantise(codes, 3) - details).max() <= 3
    flat = lifting.predict(np.full((n + 1, n + 1), 7))
    assert (flat == 7).all()


def test_rounding_is_symmetric():
    v = np.arange(-70, 71)
    assert (lifting.rounded(v, 4) == -lifting.rounded(-v, 4)).all() and lifting.rounded(np.array([2, -2, 6]), 4).tolist() == [1, -1, 2]


def test_closure_and_fixpoint(spark):
    seed = spark.createDataFrame([(40,), (41,)], "n long")
    got = loops.closure(seed, lambda d: d.where("n > 0").select(F.expr("n div 2").alias("n")), 20)
    assert sorted(r["n"] for r in got.collect()) == [0, 1, 2, 5, 10, 20, 40, 41]
    same = loops.fixpoint(seed, lambda d: d.select(F.greatest(F.expr("n div 2"), F.lit(3)).cast("long").alias("n")), 20)
    assert [r["n"] for r in same.collect()] == [3, 3]


def test_lru_against_a_plain_replay(spark):
    r = random.Random(3)
    log = [(r.randrange(3), s, r.randrange(12)) for s in range(400)]
    for kind in ("lru", "fifo"):
        want = []
        held = {}
        for c, s, k in log:
            cache = held.setdefault(c, OrderedDict())
            want.append((c, s, k in cache))
            if k in cache:
                if kind == "lru":
                    cache.move_to_end(k)
            else:
                cache[k] = 1
                if len(cache) > 5:
                    cache.popitem(last=False)
        got = replay.lru(spark.createDataFrame(log, "consumer long, seq long, key long"), 5, kind).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_ledger_and_changes(spark):
    log = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, -30), (1, 4, 50), (2, 1, 101)], "consumer long, seq long, bytes long")
    got = sorted(map(tuple, replay.ledger(log, 100).collect()))
    assert got == [(1, 1, True, 60), (1, 2, False, 60), (1, 3, True, 30), (1, 4, True, 80), (2, 1, False, 0)]
    moves = spark.createDataFrame([(1, n, v) for n, v in enumerate((0.0, 0.4, 0.6, 1.0, 1.2))], "consumer long, seq long, value double")
    assert sorted(r["seq"] for r in replay.on_change(moves, 0.5).collect()) == [0, 2, 4]
    timed = spark.createDataFrame([(1, 1, 0, 7), (1, 2, 50, 7), (1, 3, 200, 7)], "consumer long, seq long, ms long, key long")
    assert [r["hit"] for r in replay.ttl(timed, 4, 100).orderBy("seq").collect()] == [False, True, False]


def test_nearest_equals_brute_force(spark):
    r = random.Random(1)
    q = [(n, r.uniform(-50, 50), r.uniform(-50, 50)) for n in range(20)]
    p = [(n, r.uniform(-50, 50), r.uniform(-50, 50)) for n in range(300)]
    got = neighbours.nearest(spark.createDataFrame(q, "a long, x double, y double"), spark.createDataFrame(p, "b long, x double, y double"), "a", "b", 4, 12.0)
    want = set()
    for a, x, y in q:
        near = sorted(((u - x) ** 2 + (v - y) ** 2, b) for b, u, v in p if (u - x) ** 2 + (v - y) ** 2 < 144)[:4]
        want |= {(a, b, n + 1) for n, (_, b) in enumerate(near)}
    assert {(g["a"], g["b"], g["rank"]) for g in got.collect()} == want


def test_wildcards(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0, "Alpha"), (2, 1.0, 1.0, "50% off"), (3, 5.0, 5.0, "beta")], "id long, lon double, lat double, name string")
    box = (0.0, 0.0, 5.0, 5.0)
    find = lambda text, **k: [r["id"] for r in cells.search_places(places, text, box, **k).collect()]
    assert find("A") == [1, 3] and find("") == [1, 2, 3] and find("a*a") == [1] and find("b?ta") == [3] and find("0% *") == [2] and find("", skip=1, most=1) == [2]


def test_children_tile_their_parent(spark):
    one = spark.range(1).select(grid.diamond(*[grid.point(*(F.lit(v) for v in c)) for c in grid.PLANAR_ROOT]).alias("d"))
    kids = [grid.planar_child(F.col("d"), f, c) for f in (0, 1) for c in (0, 1)]
    row = one.select(*[grid.diamond_id(k).alias(f"k{n}") for n, k in enumerate(kids)], *[grid.child_id(F.col("d"), f, c).alias(f"c{f}{c}") for f in (0, 1) for c in (0, 1)]).first()
    assert [row[f"k{n}"] for n in range(4)] == [row["c00"], row["c01"], row["c10"], row["c11"]]


def test_tiles_hold_their_points(spark):
    pts = spark.createDataFrame([(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (12.3, 45.6)], "lon double, lat double")
    row, col = tiles.point_tile(F.col("lon"), F.col("lat"), 6)
    w, s, e, n = tiles.tile_bounds(F.lit(6), F.col("row"), F.col("col"))
    held = pts.withColumn("row", row).withColumn("col", col).where((F.col("lon") >= w) & (F.col("lon") <= e) & (F.col("lat") >= s) & (F.col("lat") <= n))
    assert held.count() == 4


def test_update_equals_a_full_rebuild(spark):
    r = random.Random(2)
    base = [(x, y, 0, r.randrange(256)) for x in range(8) for y in range(8)]
    new = [(x, y, 0, 255 - v) for x, y, _, v in base if x in (2, 3) and y > 4]
    kind = "x int, y int, band int, value int"
    old = raster.pyramid(spark.createDataFrame(base, kind), 3)
    got = raster.update(old, spark.createDataFrame(new, kind), 3).select("level", "x", "y", "band", "value").collect()
    changed = {(x, y): v for x, y, _, v in new}
    full = raster.pyramid(spark.createDataFrame([(x, y, b, changed.get((x, y), v)) for x, y, b, v in base], kind), 3).select("level", "x", "y", "band", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, full))


def test_record_store(spark, tmp_path):
    rows = spark.createDataFrame([(n % 2, n, -n, n * 3, bytes([n])) for n in range(50)], "kind int, i int, j int, k int, payload binary")
    stores.write_records(rows, f"{tmp_path}/s", 4)
    assert stores.read_record(spark, f"{tmp_path}/s", 1, 7, -7, 21).first()["payload"] == b"\x07"
    asks = spark.createDataFrame([(1, 7, -7, 21), (1, 7, -7, 21), (0, 9, 9, 9)], "kind int, i int, j int, k int")
    assert [r["payload"] for r in stores.fetch_records(asks, rows).orderBy("i").collect()] == [b"\x07", b"\x07", None]
    gone = spark.createDataFrame([(1, 7, -7, 21, None), (0, 2, -2, 6, b"x")], "kind int, i int, j int, k int, payload binary")
    after = stores.replace_records(rows, gone)
    assert after.count() == 49 and after.where("i = 2").first()["payload"] == b"x"


def test_rasters_and_gazetteer(spark, tmp_path):
    (tmp_path / "a_2x2x1.raw").write_bytes(bytes([1, 2, 3, 255]))
    got = stores.explode_rasters(stores.read_rasters(spark, str(tmp_path), "*.raw")).orderBy("y", "x").collect()
    assert [(r["name"], r["x"], r["y"], r["value"]) for r in got] == [("a", 0, 0, 1), ("a", 1, 0, 2), ("a", 0, 1, 3), ("a", 1, 1, 255)]
    (tmp_path / "g.xml").write_text("<places><place><id>1</id><lon>2.5</lon><lat>3</lat><elev>-9999</elev><name>A</name></place><place><id>2</id><lon>1</lon><lat>1</lat><elev>7</elev></place></places>")
    rows = stores.read_gazetteer(spark, f"{tmp_path}/g.xml").orderBy("seq").collect()
    assert [(r["name"], r["elev"]) for r in rows] == [("A", None), ("", 7.0)]


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = events.windowed_timings(events.read_events(spark, f"{tmp_path}/in", rows.schema, 1), late="60 days")
    events.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/check", "append")
    batch = events.windowed_timings(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got <= {tuple(r) for r in batch.collect()}  # the last windows stay open
    once = events.fresh_requests(events.read_events(spark, f"{tmp_path}/in", rows.schema), late="60 days")
    events.run_available(once.select("event_id"), f"{tmp_path}/once", f"{tmp_path}/check2")
    assert spark.read.parquet(f"{tmp_path}/once").count() == rows.dropDuplicates(["user_id", "event_type", "value"]).count()


def test_hulls(spark):
    from tilewright.operators.polygons import convex_hulls, monotone_chain

    r = random.Random(6)
    pts = [(n % 2, r.uniform(0, 9), r.uniform(0, 9)) for n in range(200)] + [(0, 0.0, 0.0)] * 3
    got = convex_hulls(spark.createDataFrame(pts, "g int, x double, y double").repartition(5), "g").orderBy("g", "place").collect()
    for g in (0, 1):
        own = [(x, y) for a, x, y in pts if a == g]
        hull = [(p["x"], p["y"]) for p in got if p["g"] == g]
        assert hull == monotone_chain(own)
        for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in own)


def test_proxy(spark):
    log = [(1, 1, 0, "ok"), (1, 2, 5, "ok"), (1, 3, 50, "ok"), (1, 4, 150, "same"), (1, 5, 300, "error"), (1, 6, 500, "error"), (1, 7, 501, "missing"), (1, 8, 505, "ok"), (1, 9, 600, "same"), (2, 1, 0, "same"), (2, 2, 400, "error")]
    got = replay.proxy(spark.createDataFrame(log, "key long, seq long, ms long, answer string"), 10, 100, 100).orderBy("key", "seq").collect()
    assert [r["outcome"] for r in got] == ["MISS", "HIT-MEMORY", "HIT", "REVALIDATED", "STALE", "ERROR", "MISSING", "NEGATIVE", "MISS", "MISS", "ERROR"]
