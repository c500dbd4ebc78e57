import random

from pyspark.sql import functions as F

from tilewright.operators import covering, raster


def _rows(seed, many, reach):
    r = random.Random(seed)
    boxes = [(n, x, y, x + w, y + w / 2, r.uniform(0, 5)) for n in range(many) for x, y, w in [(r.uniform(-20, 20), r.uniform(-20, 20), r.uniform(0, reach))]]
    points = [(n, r.uniform(-20, 25), r.uniform(-20, 25)) for n in range(200)] + [(200, boxes[3][1], boxes[3][2]), (201, boxes[4][3], boxes[4][4]), (202, 500.0, 0.0)]
    return boxes, points


def test_best_boxes_with_few_tried(spark):
    """As trying all boxes over each point, for scores that change within boxes; few are tried."""
    boxes, points = _rows(6, 1500, 20.0)
    df = spark.createDataFrame(boxes, "box long, west double, south double, east double, north double, base double")
    asks = spark.createDataFrame(points, "id long, lon double, lat double")
    score = lambda lon: F.col("base") + (lon - F.col("west")) * 0.01
    bounds = lambda x0, y0, x1, y1: (covering.inside(x0, y0, x1, y1), score(x0) - 1e-9, score(x1) + 1e-9)
    pairs = covering.candidates(asks, df, "box", 4.0, 3, bounds).where("lon >= west and lon <= east and lat >= south and lat <= north").select("id", "box", score(F.col("lon")).alias("score")).toPandas()
    whole, want = 0, {}
    for n, lon, lat in points:
        over = [(base + (lon - w) * 0.01, b) for b, w, s, e, t, base in boxes if w <= lon <= e and s <= lat <= t]
        whole += len(over)
        if over:
            want[n] = min(over)[1]
    best = pairs.sort_values(["score", "box"]).groupby("id").first()
    assert best["box"].to_dict() == want
    assert whole > 9_000 and len(pairs) < whole / 3


def test_ties_and_first_tiles(spark):
    """Equal scores: all of them, or any; no box over a point; tiles by number."""
    boxes, points = _rows(7, 300, 30.0)
    df = spark.createDataFrame([(b, w, s, e, t, 1.0) for b, w, s, e, t, _ in boxes], "box long, west double, south double, east double, north double, base double")
    asks = spark.createDataFrame(points, "id long, lon double, lat double")
    bounds = lambda *at: (covering.inside(*at), F.col("base"), F.col("base"))
    over = {n: {b for b, w, s, e, t, _ in boxes if w <= lon <= e and s <= lat <= t} for n, lon, lat in points}
    for ties in (True, False):
        found = {}
        for r in covering.candidates(asks, df, "box", 8.0, 2, bounds, ties).where("lon >= west and lon <= east and lat >= south and lat <= north").collect():
            found.setdefault(r["id"], set()).add(r["box"])
        assert found.keys() == {n for n, v in over.items() if v}
        assert all(v == over[n] if ties else v <= over[n] for n, v in found.items())
    tiles = df.select((F.col("box") * 37 % 301).alias("tile"), "west", "south", "east", "north", F.when(F.col("box") % 4 > 0, F.col("box").cast("int")).alias("value"))
    got = {r["id"]: (r["tile"], r["value"]) for r in raster.first_valid(asks, tiles, 8.0).collect()}
    want = {n: min(((b * 37 % 301, b) for b in v if b % 4), default=None) for n, v in over.items()}
    assert got == {n: v for n, v in want.items() if v}
