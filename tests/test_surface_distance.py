import numpy as np
import pytest

from tilewright.operators import blocks
from tilewright.operators import surface_distance as sd


def test_distance_by_sampling():
    """No sampled place of a triangle is nearer, and one is nearly as near."""
    r = np.random.default_rng(1)
    t, p = r.normal(size=(300, 3, 3)), r.normal(size=(300, 3)) * 2
    t[:20, 2] = t[:20, 1]  # lines
    t[20:25, 1:] = t[20:25, :1]  # points
    w = r.dirichlet([0.7, 0.7, 0.7], 4000)
    w = np.concatenate([w, np.eye(3), np.stack([np.linspace(0, 1, 200), np.linspace(1, 0, 200), np.zeros(200)], 1)[:, [0, 1, 2]], np.stack([np.zeros(200), np.linspace(0, 1, 200), np.linspace(1, 0, 200)], 1), np.stack([np.linspace(1, 0, 200), np.zeros(200), np.linspace(0, 1, 200)], 1)])
    got = sd.distances(p, t)
    for k in range(300):
        near = np.sqrt((((w @ t[k]) - p[k]) ** 2).sum(axis=1)).min()
        assert got[k] <= near + 1e-9 and near - got[k] < 0.1


@pytest.mark.parametrize("size", [0.05, 1.0, 50.0])
def test_nearest(spark, size):
    """Against all pairs, for any cell size: near, far and very far points, ties, repeated triangles."""
    r = np.random.default_rng(2)
    t = r.normal(size=(300, 1, 3)) * 10 + r.normal(size=(300, 3, 3)) * 0.3
    t[250:] = t[:50]
    p = np.concatenate([r.normal(size=(60, 3)) * 10, r.normal(size=(15, 3)) * 100, [[4000.0, 0, 0], [0, 0, 0]], t[0]])
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, z double")
    triangles = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(t)], "triangle long, t array<double>")
    got = {x["id"]: x for x in sd.nearest(points, triangles, size).collect()}
    assert set(got) == set(range(len(p)))
    for k, v in enumerate(p):
        d = sd.distances(np.repeat(v[None], len(t), axis=0), t)
        assert got[k]["distance"] == d.min() and got[k]["triangle"] == int(np.flatnonzero(d == d.min())[0])
    assert sd.nearest(points, triangles.limit(0), size).count() == 0
    assert sd.nearest(points.limit(0), triangles, size).count() == 0


def test_rough_distances():
    """The squares that choose pairs agree with the exact distances, except for thin triangles, which get 0."""
    r = np.random.default_rng(3)
    t, p = r.normal(size=(200, 3, 3)), r.normal(size=(90, 3)) * 3
    t[:10, 2] = t[:10, 1]
    rough = np.sqrt(sd._rough(p, t))
    exact = np.stack([sd.distances(np.repeat(v[None], len(t), axis=0), t) for v in p])
    assert (rough[:, :10] == 0).all() and np.abs(rough - exact)[:, 10:].max() < 1e-9


def test_nothing_exploded_is_broadcast(spark, monkeypatch):
    """Points and triangles are small as tables, but not once they are in cells; blocks cut small give the same."""
    for name, value in (("MOST_ROWS", 0), ("SHARD", 7), ("SLICE", 5), ("STEP", 3)):
        monkeypatch.setattr(blocks, name, value)
    r = np.random.default_rng(4)
    t, p = r.normal(size=(120, 1, 3)) + r.normal(size=(120, 3, 3)) * 0.3, r.normal(size=(40, 3)) * 3
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, z double")
    triangles = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(t)], "triangle long, t array<double>")
    out = sd.nearest(points, triangles, 0.5)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x["id"]: (x["triangle"], x["distance"]) for x in out.collect()}
    for k, v in enumerate(p):
        d = sd.distances(np.repeat(v[None], len(t), axis=0), t)
        assert got[k] == (int(d.argmin()), d.min())
