import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import neighbours


def _points(spark, rows):
    return spark.createDataFrame(rows, "p long, x double, y double, kind int")


def test_few_pairs_within_a_wide_radius(spark):
    """All points are within the radius of all queries, but only the near ones are tried."""
    r = random.Random(4)
    points = _points(spark, [(n, r.uniform(0, 10), r.uniform(0, 10), n % 3) for n in range(3000)])
    queries = spark.createDataFrame([(n, r.uniform(0, 10), r.uniform(0, 10)) for n in range(200)], "q long, x double, y double")
    tried = spark.sparkContext.accumulator(0)

    def look(_):
        tried.add(1)
        return True

    look = F.udf(look, "boolean")
    got = neighbours.nearest(queries, points, "q", "p", 5, 30.0, accept=lambda q, p: look(p("kind"))).collect()
    assert len(got) == 1000
    assert tried.value < 200 * 300


@pytest.mark.parametrize("k", [1, 4])
def test_clusters_copies_and_gaps(spark, k):
    """Queries far from tight clusters, places with many copies, other orders, and kinds that are rare."""
    r = random.Random(5)
    spots = [(0.0, 0.0, 1e-3), (8.0, 8.0, 0.5), (-9.0, 3.0, 0.0)]
    p = [(n, *(v + r.gauss(0, spots[n % 3][2]) for v in spots[n % 3][:2]), int(n % 50 == 7)) for n in range(600)] + [(600, 100.0, 0.0, 1)]
    q = [(n, r.uniform(-12, 12), r.uniform(-12, 12)) for n in range(60)] + [(60, -9.0, 3.0), (61, 0.0, 0.0), (62, 300.0, 0.0), (63, 100.0, 0.0)]
    asks = spark.createDataFrame(q, "q long, x double, y double")
    for rare in (False, True):
        got = neighbours.nearest(asks, _points(spark, p), "q", "p", k, 15.0, accept=(lambda a, b: b("kind") == 1) if rare else None, order=lambda d2, b: [F.sqrt(d2), -b("p")])
        want = set()
        for a, x, y in q:
            near = sorted(((u - x) * (u - x) + (v - y) * (v - y), -b) for b, u, v, kind in p if (u - x) * (u - x) + (v - y) * (v - y) < 225 and (kind or not rare))[:k]
            want |= {(a, -b, n + 1) for n, (_, b) in enumerate(near)}
        assert {(g["q"], g["p"], g["rank"]) for g in got.collect()} == want
    assert neighbours.nearest(asks, _points(spark, p[:0] + p[:1]).limit(0), "q", "p", k, 15.0).count() == 0
    assert neighbours.nearest(asks.limit(0), _points(spark, p), "q", "p", k, 15.0).count() == 0


@pytest.mark.parametrize("name", ["placenames_in_view", "poi_picks"])
def test_queries_use_the_bounded_search(spark, name, monkeypatch):
    """Views and clicks get their places from cells as wide as these are away, not from all within reach."""
    from tilewright import catalog

    calls, whole = [], neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda *a, **k: calls.append(k["k"]) or whole(*a, **k))
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
