import numpy as np
import pytest

from tilewright.functions import geo
from tilewright.operators import triangles as tri
from tilewright.plans import triangles as plan

FOLDER = "/root/testdata/sf0.001"
M = geo.multiply(geo.perspective(1.0, 1.0, 1.0, 100.0), geo.look_at((0.0, 0.0, 10.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0)))


def shapes(n, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, 1, 3)) * 8 + r.normal(size=(n, 3, 3)) * 4


def frame(spark, points, uv=None):
    uv = np.random.default_rng(2).random((len(points), 3, 2)) if uv is None else uv
    return spark.createDataFrame([(k, p.ravel().tolist(), t.ravel().tolist()) for k, (p, t) in enumerate(zip(points, uv, strict=True))], "id long, xyz array<double>, uv array<double>")


def test_clipped_points_lie_in_view_and_in_the_triangle():
    clip = tri.to_clip(np.array(M).reshape(4, 4), shapes(500))
    weights = np.broadcast_to(np.eye(3), (500, 3, 3))
    out, count = tri.clipped(np.concatenate([clip, weights], axis=2))
    assert count.max() > 4 and (count == 0).any() and (count[count > 0] >= 3).all()
    for k in range(500):
        for v in out[k, : count[k]]:
            assert (np.abs(v[:3]) <= v[3] + 1e-9).all()
            assert v[4:].min() >= -1e-9 and abs(v[4:].sum() - 1) < 1e-9
            assert np.allclose(v[:4], v[4:] @ clip[k])


def test_area_by_counting_pixels(spark):
    """The area of what is clipped, also behind the eye, against rays through a grid of pixels."""
    points = shapes(40, 3)
    got = {r["id"]: r for r in tri.project(frame(spark, points), M, 80.0, 80.0, cull=False).collect()}
    step = np.tan(0.5)
    px = (np.arange(400) + 0.5) / 400 * 2 - 1
    x, y = np.meshgrid(px * step, px * step)
    rays = np.stack([x.ravel(), y.ravel(), -np.ones(x.size)], axis=1)
    eye = np.array([0.0, 0.0, 10.0])
    for k, p in enumerate(points):
        e1, e2 = p[1] - p[0], p[2] - p[0]
        h = np.cross(rays, e2)
        det = h @ e1
        s = eye - p[0]
        u = h @ s / det
        q = np.cross(s, e1)
        v = rays @ q / det
        t = (q @ e2) / det
        hit = (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 1) & (t <= 100)
        area = hit.mean() * 6400
        if got[k]["state"] == "shown":
            assert abs(got[k]["area"] - area) < 20 + 0.02 * area
            assert got[k]["left"] >= -1e-6 and got[k]["right"] <= 80 + 1e-6
        else:
            assert area < 1


def test_culled_ones_show_their_back(spark):
    points = shapes(300, 4)
    rows = {r["id"]: r["state"] for r in tri.project(frame(spark, points), M, 80.0, 80.0).collect()}
    normal = np.cross(points[:, 1] - points[:, 0], points[:, 2] - points[:, 0])
    front = (normal * (np.array([0, 0, 10.0]) - points[:, 0])).sum(axis=1) > 0
    assert 50 < sum(s == "culled" for s in rows.values()) < 250
    assert len({front[k] for k, s in rows.items() if s == "culled"}) == 1
    assert not any(front[k] == front[next(i for i, s in rows.items() if s == "culled")] for k, s in rows.items() if s == "shown")


def test_density_of_a_wall(spark):
    """A square of two units at distance 10, its texture once across: pixels to a unit of texture."""
    wall = np.array([[[-1.0, -1, 0], [1, -1, 0], [-1, 1, 0]]])
    got = tri.project(frame(spark, wall, np.array([[[0.0, 0], [1, 0], [0, 1]]])), M, 100.0, 100.0, cull=False).first()
    assert got["density"] == pytest.approx(2 / 10 / np.tan(0.5) * 50)
    flat = tri.project(frame(spark, wall, np.zeros((1, 3, 2))), M, 100.0, 100.0, cull=False).first()
    assert flat["density"] is None and flat["state"] == "shown"
    assert tri.project(frame(spark, wall).limit(0), M, 100.0, 100.0).count() == 0


@pytest.mark.parametrize("eye", [plan._EYE, (0.0, 0.0, 1.01 * geo.RADIUS), (0.0, 0.0, 0.0)])
def test_no_front_in_a_rejected_block(spark, eye):
    ground = plan.ground(spark, FOLDER)
    blocks = {(r["level"], r["row"], r["col"]): r for r in tri.facing_blocks(ground, eye, 5).collect()}
    told = 0
    for r in ground.collect():
        p = np.array(r["xyz"]).reshape(3, 3)
        side = np.cross(p[1] - p[0], p[2] - p[0]) @ (np.array(eye) - p[0])
        for level in range(6):
            b = blocks[level, r["row"] >> (5 - level), r["col"] >> (5 - level)]
            if b["facing"]:
                told += 1
                assert (side > 0) == (b["facing"] == 1)
    assert told > 50 and sum(b["triangles"] for k, b in blocks.items() if k[0] == 0) == ground.count()


def test_segments(spark):
    """The part that is in view, by walking along the segment."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    a, b = r.normal(size=(200, 3)) * 9, r.normal(size=(200, 3)) * 9
    a[0], b[0] = (0, 0, 0), (0, 0, 20)  # through the eye, out behind it
    rows = [(k, *map(float, a[k]), *map(float, b[k])) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    planes = geo.planes(M)
    first, last = geo.clip_segment(*(tuple(F.col(f"{p}{k}") for k in range(3)) for p in "ab"), planes)
    got = {r["id"]: (r["first"], r["last"]) for r in df.select("id", first.alias("first"), last.alias("last")).collect()}
    steps = np.linspace(0, 1, 5001)
    shown = 0
    for k in range(200):
        p = a[k] + steps[:, None] * (b[k] - a[k])
        inside = np.all([p @ np.array(n[:3]) + n[3] >= 0 for n in planes], axis=0)
        if got[k][0] is None:
            assert inside.sum() <= 1
        else:
            shown += 1
            assert abs(steps[inside].min(initial=got[k][0]) - got[k][0]) < 1e-3 and abs(steps[inside].max(initial=got[k][1]) - got[k][1]) < 1e-3
    assert 10 < shown < 190 and got[0][0] == 0 and got[0][1] == pytest.approx(9 / 20)
