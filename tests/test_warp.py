import numpy as np
import pytest

from tilewright.operators import warp

SOURCE = "raster long, width int, height int, bands int, level int, x0 double, x_col double, x_row double, y0 double, y_col double, y_row double"
PIXELS = "raster long, x int, y int, band int, value int"


def pixels_of(raster, w, h, bands, value):
    return [(raster, x, y, b, value(x, y, b)) for x in range(w) for y in range(h) for b in range(bands)]


def warped(spark, sources, pixels, size, quad=16):
    rows = warp.warp(spark.createDataFrame(sources, SOURCE), warp.blocks(spark.createDataFrame(pixels, PIXELS), size), quad, size=size)
    return {tuple(r[:5]): r[5] for r in rows.collect()}


def test_blocks_leave_no_seams(spark):
    """Any block size gives the same pixels: turned, sheared, beyond the map's edge, with holes."""
    r = np.random.default_rng(1)
    sources = [(1, 13, 17, 3, 2, -20.0, 2.0, 0.5, 30.0, 0.3, -2.0), (2, 16, 16, 1, 1, 170.0, 3.0, 0.0, 88.0, 0.0, -3.0), (3, 9, 9, 3, 3, 10.0, 0.0, -1.0, 10.0, 1.0, 0.0)]
    pixels = [p if r.random() > 0.1 else (*p[:4], None) for s in sources for p in pixels_of(s[0], s[1], s[2], s[3], lambda x, y, b: int(r.integers(0, 256)))]
    whole = warped(spark, sources, pixels, 64)
    assert whole and len({k[0] for k in whole}) == 3
    for size in (1, 4, 5):
        assert warped(spark, sources, pixels, size) == whole


def test_same_grid_is_the_same_raster(spark):
    """A source whose pixels are those of the level comes back unchanged; one of one band is in all three."""
    step = 180 / 2 / 16
    pixels = pixels_of(7, 8, 8, 1, lambda x, y, b: x * 20 + y)
    got = warped(spark, [(7, 8, 8, 1, 1, -180 + 4 * step, step, 0.0, 90 - 2 * step, 0.0, -step)], pixels, 4)
    assert got == {(7, 1, x + 4, y + 2, b): x * 20 + y for x in range(8) for y in range(8) for b in range(3)}


def test_ramp_is_interpolated(spark):
    """A ramp stays one at twice the resolution, and its border isn't mixed with zeros."""
    step = 180 / 2 / 16
    pixels = pixels_of(1, 8, 2, 1, lambda x, y, b: 100 + 8 * x)
    got = warped(spark, [(1, 8, 2, 1, 1, 0.0, 2 * step, 0.0, 2 * step, 0.0, -2 * step)], pixels, 3)
    row = [v for k, v in sorted(got.items()) if k[4] == 0 and k[3] == min(q[3] for q in got)]
    assert row == [100, *(102 + 4 * k for k in range(14)), 156]


def test_last_source_on_top(spark):
    step = 180 / 2 / 16
    place = (0.0, step, 0.0, 4 * step, 0.0, -step)
    pixels = pixels_of(1, 4, 4, 3, lambda x, y, b: 50) + pixels_of(2, 4, 4, 3, lambda x, y, b: 0 if x < 2 else 90)
    rows = warp.warp(spark.createDataFrame([(1, 4, 4, 3, 1, *place), (2, 4, 4, 3, 1, *place)], SOURCE), warp.blocks(spark.createDataFrame(pixels, PIXELS), 4), 16, size=4)
    got = {(r["x"], r["y"], r["band"]): r["value"] for r in warp.insert(rows, 16, least=10).where("quad_x = 2 and quad_y = 0").collect()}
    assert got == {(x, 12 + y, b): 50 if x < 2 else 90 for x in range(4) for y in range(4) for b in range(3)}


def test_other_numbers_of_bands(spark):
    with pytest.raises(Exception, match="unsupported number of bands: 2"):
        warped(spark, [(1, 4, 4, 2, 1, 0.0, 1.0, 0.0, 4.0, 0.0, -1.0)], pixels_of(1, 4, 4, 2, lambda x, y, b: 1), 4)


def test_levels(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(12.0,), (11.25,), (6.0,), (5.625,), (0.001,)], "step double").select(warp.level_for(F.col("step"), 16, 5)).collect()
    assert [r[0] for r in rows] == [0, 0, 1, 1, 5]


def test_last_pixels_in_batches(spark, monkeypatch):
    """What many blocks at once give is what combining every source's pixels gives: bands of
    their own holes, sources of one band, low pixels, beyond the map's edge."""
    r = np.random.default_rng(4)
    monkeypatch.setattr(warp, "MOST_PIXELS", 500)
    sources = [(k, 9 + k % 5, 12, 1 if k % 3 == 0 else 3, 1 + k % 3, float(r.uniform(-180, 180)), 1.5, 0.3, float(r.uniform(-90, 90)), 0.2, -1.5) for k in range(20)]
    pixels = [p for s in sources for p in pixels_of(s[0], s[1], s[2], s[3], lambda x, y, b: int(r.integers(0, 60))) if r.random() > 0.4]
    sources.append((50, 5, 5, 3, 1, 0.0, 1.5, 0.0, 0.0, 0.0, -1.5))  # without pixels
    given, known = spark.createDataFrame(sources, SOURCE), spark.createDataFrame(pixels, PIXELS)
    whole = sorted(map(tuple, warp.insert(warp.warp(given, warp.blocks(known, 4), 16, size=4), 16, 20).collect()))
    got = warp.in_quads(warp.last_pixels(given, warp.banded_blocks(known, 4), 16, 20, size=4), 16)
    assert sorted(map(tuple, got.collect())) == whole and len(whole) > 500
    assert warp.last_pixels(given, warp.banded_blocks(known.limit(0), 4), 16, 20, size=4).count() == 0
