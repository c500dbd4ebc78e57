import numpy as np
import pytest

from tilewright.functions import geo, grid
from tilewright.operators import globe_cut as cuts

CORNERS = np.array([[grid.CYLINDER_POINTS[c] for c in r] for r in grid.CYLINDER_ROOTS])
NONE = [0.0, 0.0, 0.0, 1.0] * 6
AWAY = [0.0, 0.0, 0.0, -1.0] * 6


@pytest.fixture(scope="module")
def found(spark):
    near = [0.0, 0.0, geo.RADIUS + 300000.0]
    pole = [0.0, geo.RADIUS + 300000.0, 10.0]
    rows = [(1, near, NONE), (2, pole, NONE), (3, near, AWAY), (4, [float(v) for v in cuts.unit((CORNERS[0, 0] + CORNERS[0, 2]) // 2) * (geo.RADIUS - 1000)], NONE)]
    nodes, refined = cuts.cut(spark.createDataFrame(rows, "camera long, eye array<double>, planes array<double>"), 0.15, 32, 5, 0.0, 5000.0)
    return nodes.collect(), refined.collect(), cuts.leaves(nodes, refined).collect()


def key(r):
    return r["camera"], r["level"], r["i"], r["j"], r["k"]


def test_every_parent_of_a_refined_diamond_is_refined(found):
    nodes, refined, _ = found
    split = {key(r) for r in refined}
    assert len(split) == len(refined) and len({key(r) for r in nodes}) == len(nodes)
    for r in refined:
        for n in (3, 9):
            p = r["d"][n : n + 3]
            if r["level"] and max(abs(v) for v in p) <= grid.HALF:
                assert (r["camera"], r["level"] - 1, *p) in split
    # and none but those that are large, or that another one depends on
    needed = {(r["camera"], r["level"] - 1, *r["d"][n : n + 3]) for r in refined for n in (3, 9)}
    size = {key(r): r["priority"] for r in nodes}
    assert all(size[k] > 0.15 or k in needed for k in split)
    assert all(size[k] <= 0.15 or k[1] == 5 for k in set(size) - split)
    assert any(size[k] <= 0.15 for k in split)


def test_leaves_cover_the_globe_once(found):
    """The sides of the leaves of a camera are triangles whose areas add up to the unrolled cylinder's."""
    _, _, leaves = found
    for camera in (1, 2, 3, 4):
        total = sum(bin(r["sides"]).count("1") / (1 << r["level"]) for r in leaves if r["camera"] == camera)
        assert total == 16  # eight roots of two sides


def test_views(found):
    nodes, refined, leaves = found
    assert not any(r["visible"] or r["priority"] for r in nodes if r["camera"] == 3)
    assert len([r for r in leaves if r["camera"] == 3]) == 8
    assert max(r["priority"] for r in nodes if r["camera"] == 4) == cuts.INSIDE
    assert max(r["level"] for r in leaves if r["camera"] == 1) == 5


def test_children_agree_from_both_parents():
    """Round the edges of the faces as well: a diamond is the same from either side."""
    level = CORNERS
    for _ in range(4):
        kids = {}
        for side in (0, 1):
            for which in (0, 1):
                fine = cuts.inside(level[:, 1 + 2 * side])
                for d in cuts.child(level[fine], side, which):
                    me = tuple((d[0] + d[2]) // 2)
                    assert kids.setdefault(me, d.tolist()) == d.tolist()
        level = np.array(list(kids.values()))
    for d in level:
        assert (np.abs(d[[0, 2]]) <= grid.HALF).all()


def test_boxes_hold_their_corners():
    centre, axes, half = cuts.boxes(CORNERS, -100.0, 9000.0, geo.RADIUS)
    assert np.allclose(np.einsum("nad,nbd->nab", axes, axes), np.eye(3), atol=1e-9)
    for c in range(4):
        for h in (-100.0, 9000.0):
            p = cuts.unit(CORNERS[:, c]) * (geo.RADIUS + h)
            assert (cuts.distances(centre, axes, half, p) < 1e-3).all()
    # along an axis a box shows the rectangle of the two others
    assert np.allclose(cuts.areas(axes, half, axes[:, 2]), 4 * half[:, 0] * half[:, 1])
    assert np.allclose(cuts.distances(centre, axes, half, centre + axes[:, 0] * (half[:, :1] + 50)), 50)


def test_cameras_of_a_batch_are_cut_alone(spark):
    """In one pass over cameras that are dealt out: the same in batches of any size, with the
    sides and the refined diamonds that the joins of ``leaves`` find."""
    rows = [(n, [float(v) for v in cuts.unit(CORNERS[n % 8, 0]) * (geo.RADIUS + 3e5 + 1e5 * n)], AWAY if n == 5 else NONE) for n in range(9)]
    cameras = spark.createDataFrame([*rows, (None, rows[0][1], NONE)], "camera long, eye array<double>, planes array<double>")
    nodes, refined = cuts.cut(cameras, 0.15, 32, 4, 0.0, 5000.0)
    want = {(key(r), r["sides"], r["visible"], round(r["priority"], 9)) for r in cuts.leaves(nodes, refined).collect()}
    marked = cuts.marked(cameras, 0.15, 32, 4, 0.0, 5000.0)
    assert "Join" not in marked._jdf.queryExecution().executedPlan().toString()
    assert marked.rdd.getNumPartitions() >= 4
    for batch, kept in ((512, 100_000), (1, 0)):
        found = {(k, sides, seen, round(size, 9)) for some in by_kernel(rows, batch, kept) for k, sides, seen, size in some}
        assert found == want


def by_kernel(rows, batch, kept):
    """Leaves by the kernel alone, in batches of cameras, with its diamonds kept or not."""
    known = cuts._Diamonds(0.0, 5000.0, geo.RADIUS)
    for n in range(0, len(rows), batch):
        some = rows[n : n + batch]
        known = known if len(known.at) <= kept else cuts._Diamonds(0.0, 5000.0, geo.RADIUS)
        eyes, planes = np.array([r[1] for r in some]), np.array([r[2] for r in some]).reshape(len(some), -1, 4)
        who, ids, seen, size, split, sides = cuts._cut_batch(known, eyes, planes, 0.15, 32, 4)
        yield [((some[w][0], int(known.level[d]), *known.place[d].tolist()), s, v, p) for w, d, s, v, p, r in zip(who, ids, sides.tolist(), seen.tolist(), size.tolist(), split, strict=True) if not r]


def test_requests_count_cameras_without_a_join(spark):
    """One pass over marked diamonds: nothing but the cameras and the sums is shuffled."""
    from tilewright.catalog import queries

    plan = queries()["cut_requests"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2
