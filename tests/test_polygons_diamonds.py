import random

from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.operators import diamonds, polygons
from tilewright.plans.grid import descend


def clipped(ring, axis, bound, above):
    out = []
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        da, db = ((p[axis] - bound) * (1 if above else -1) for p in (a, b))
        if da >= 0:
            out.append(a)
        if (da < 0) != (db < 0):
            out.append(tuple(bound if k == axis else a[k] + (b[k] - a[k]) * da / (da - db) for k in (0, 1)))
    return out


def test_clip_half_as_point_by_point(spark):
    pick = random.Random(3)
    rings = [[(pick.uniform(-3, 3), pick.uniform(-3, 3)) for _ in range(pick.randint(3, 7))] for _ in range(60)] + [[], [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0)]]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "k int, ring array<struct<x: double, y: double>>")
    for axis, bound, above in (("x", 1.0, True), ("y", -0.5, False)):
        got = {r["k"]: [(p["x"], p["y"]) for p in r["ring"]] for r in frame.select("k", polygons.clip_half(F.col("ring"), axis, F.lit(bound), above).alias("ring")).collect()}
        for k, ring in enumerate(rings):
            want = clipped(ring, "xy".index(axis), bound, above)
            assert len(got[k]) == len(want)
            assert all(abs(a - b) < 1e-9 for p, q in zip(got[k], want, strict=True) for a, b in zip(p, q, strict=True))


def test_parents_are_corners_of_the_diamonds(spark):
    """Keys and parents in closed form, against diamonds made by splitting from the root."""
    kind = "struct<i:bigint,j:bigint,k:bigint>"
    root = spark.createDataFrame([(0, *grid.PLANAR_ROOT)], f"root int, c0 {kind}, c1 {kind}, c2 {kind}, c3 {kind}").select("root", grid.diamond(*(F.col(f"c{n}") for n in range(4))).alias("d"))
    half, unit = 8, grid.HALF // 8
    every = descend(root, 5, cylinder=False)
    me = grid.diamond_id(F.col("d"))
    rows = every.select("level", *[((p[a] + grid.HALF) / unit).cast("long").alias(f"{n}_{a}") for n, p in (("id", me), ("c1", F.col("d.c1")), ("c3", F.col("d.c3"))) for a in "ij"]).collect()

    def inside(p):
        return all(0 <= v <= 2 * half for v in p)

    want = {}
    for r in rows:
        if inside((r["id_i"], r["id_j"])):
            want.setdefault((r["level"], r["id_i"], r["id_j"]), set()).update(p for p in ((r["c1_i"], r["c1_j"]), (r["c3_i"], r["c3_j"])) if inside(p))
    keys = spark.createDataFrame(list(want), "level int, x long, y long")
    got = {k: set() for k in want}
    for r in diamonds.with_parents(keys, half).collect():
        got[r["level"], r["x"], r["y"]].add((r["parent_x"], r["parent_y"]))
        assert (r["parent_level"], r["parent_x"], r["parent_y"]) in want
    assert {k: v for k, v in got.items() if k[0]} == {k: v for k, v in want.items() if k[0]}
