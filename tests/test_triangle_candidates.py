import math

import numpy as np

from tilewright.functions import geo
from tilewright.operators import blocks
from tilewright.plans import rays


def _place(lon, lat, r):
    a, b = math.radians(lon), math.radians(lat)
    return np.array([math.sin(a) * math.cos(b), math.sin(b), math.cos(a) * math.cos(b)]) * r


def test_few_triangles_are_tried(spark, monkeypatch):
    """Of 150 triangles over each other, as many as shards for each ray, and the one that all pairs give is among them."""
    monkeypatch.setattr(blocks, "SHARD", 60)
    r = np.random.default_rng(5)
    tri = [(k, w, s, w + 4, s + 4, float(h)) for k, (w, s, h) in enumerate(zip(r.uniform(-32, -28, 150).tolist(), r.uniform(38, 42, 150).tolist(), r.integers(0, 9000, 150), strict=True))]
    tri += [(200 + k, *tri[k][1:]) for k in range(5)]  # ties
    ask = [(k, float(x), float(y)) for k, (x, y) in enumerate(r.uniform(-1, 1, (40, 2)) * 4 + [-28, 42])]
    got = rays.triangle_candidates(spark.createDataFrame(ask, "ray long, lon double, lat double"), spark.createDataFrame(tri, "id long, west double, south double, east double, north double, h double"), 5.0).collect()
    by = {}
    for x in got:
        by.setdefault(x["ray"], set()).add(x["id"])
    for k, lon, lat in ask:
        best, way = {}, -_place(lon, lat, 1.0)
        for n, w, s, e, north, h in tri:
            if w <= lon <= e and s <= lat <= north:
                a, b, c = (_place(*v, geo.RADIUS + h) for v in ((w, s), (e, s), (w, north)))
                share = np.linalg.solve(np.stack([b - a, c - a, -way], axis=1), -2 * way * geo.RADIUS - a)
                if share[0] >= 0 and share[1] >= 0 and share[0] + share[1] <= 1:
                    best[n] = share[2]
        if best:
            nearest = min(best.values())
            assert {n for n, t in best.items() if t <= nearest + 1e-6} <= by[k]
        assert len(by.get(k, ())) <= 12
