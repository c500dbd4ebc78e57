import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import topk, whitening

SCHEMA = "vec_id long, embedding array<double>"
ODD = [(None, [1.0, 2.0]), (901, None), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [float("inf"), 1.0]), (905, [])]


def clashing(df):
    for name in ("dim", "x", "band", "norm", "slice", "part", "n", "component", "score", "place"):
        df = df.withColumn(name, F.lit("other"))
    return df


def brute(rows, k=20, every=20):
    """Exact answers by Python's integers."""
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            x = [math.floor(64 * c) for c in v]
            vectors[i] = min(vectors.get(i, x), x)
    out = {}
    for q, a in vectors.items():
        if q % every == 0:
            scored = sorted((-sum(s * t for s, t in zip(a, b, strict=True)), i) for i, b in vectors.items() if i != q and len(b) == len(a))
            if scored:
                out[q] = [(i, -s if -(1 << 63) < s < 1 << 63 else None) for s, i in scored[:k]]
    return out


def searched(df, **kw):
    out = {}
    for r in sorted(topk.search(df, **kw).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(params=["few", "blocks"])
def blocks(request, monkeypatch):
    """Also with many small blocks, slices and batches."""
    if request.param == "blocks":
        monkeypatch.setattr(topk, "BLOCK_VALUES", 1)
        monkeypatch.setattr(topk, "SLICE_VALUES", 1)
        monkeypatch.setattr(topk, "PAIRS", 64)
    return request.param


def test_best_by_product(spark, blocks):
    """Copies, ties, unlike norms, other lengths, a repeated id, zero and unusable vectors."""
    r = np.random.default_rng(4)
    x = r.normal(size=(2600, 24)) * np.exp(r.normal(size=(2600, 1)))
    x[1000:1700] = x[20]  # copies of a query
    x[1800:1900] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, r.normal(size=3).round(1).tolist()) for i in range(60)] + ODD
    rows += [(7000, [0.5] * 24), (7000, [0.25] * 24)]
    assert searched(clashing(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_huge_products(spark):
    """Products that a double doesn't hold exactly are exact, and null beyond a long."""
    rows = [(i, [2.0**40 + i / 64, -(2.0**39) + (i % 7) / 64, float(i)]) for i in range(41)] + [(100 + i, [2.0**25 + i / 64, 1.0 + i]) for i in range(30)]
    got = searched(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert any(s is None for _, s in got[0]) and all(s is not None for _, s in got[100])


def test_few_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.search(none).count() == 0 and whitening.whitened(none).count() == 0
    assert topk.search(spark.createDataFrame([(20, [1.0])], SCHEMA)).count() == 0
    rows = [(20, [1.0]), (3, [2.0]), (40, [])]
    assert searched(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == {20: [(3, 8192)]}


def test_pairs_are_left_out():
    """Bounds leave most pairs out before their last range, and never one that reaches the bound."""
    r = np.random.default_rng(6)
    x = np.floor(64 * r.normal(size=(4000, 64)) * np.linspace(3, 0.2, 64)).astype(np.int64)
    columns, rest = topk.vertical(x)
    columns, rest = [np.frombuffer(c, np.int64).reshape(-1, len(x)) for c in columns], np.frombuffer(rest).reshape(4, -1)
    exact = (x[:50] @ x.T).astype(float)
    bounds = np.sort(exact, axis=1)[:, -20]
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, tuple):
                touched.append(np.asarray(out).shape[1])
            return np.asarray(out)

    who, row, scores = topk.surviving(x[:50].astype(float), bounds, [c.astype(float).view(Counted) for c in columns], rest, 20)
    assert set(zip(who.tolist(), row.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(exact >= bounds[:, None])), strict=True))
    assert (scores == exact[who, row]).all()
    assert touched[0] == 4000 and touched[-1] < 50 * 4000 // 8  # rows of the first range, pairs of the last


def fit_of(rows):
    seen = {tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in rows}
    return np.array(sorted(seen), dtype=object)


def check(rows, got, dim):
    fit = fit_of(rows)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(16, dim)
    assert {r["component"] for r in got} == set(range(1, k + 1))
    signs = {}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i, c in rows:
        x = np.array([math.floor(64 * a) + 1_000_000 for a in c], dtype=object)
        d = n * x - sums
        for j in range(1, k + 1):
            r = by[i, j]
            assert r["n"] == n and r["deviation"] == int((d * d).sum())
            assert abs(r["explained"] - e[j - 1] / e.sum()) <= 1e-9
            assert r["identity_error"] <= 1e-9
            w = float((d / n).astype(float) @ v[:, j - 1]) / math.sqrt(e[j - 1])
            if abs(w) > 1e-6:
                sign = signs.setdefault(j, 1 if w * r["whitened"] > 0 else -1)
                assert abs(r["whitened"] - sign * w) < 1e-7


@pytest.mark.parametrize("dim", [3, 40])
def test_whitened(spark, dim):
    """Against the eigenvectors of the covariance; repeated rows, copies that count once, many partitions."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(700, dim)) * np.linspace(1.5, 0.3, dim)
    x[300:500] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())]
    df = clashing(spark.createDataFrame(rows + ODD[1:], SCHEMA).repartition(37))
    got = whitening.whitened(df).collect()
    assert len(got) == len(rows) * min(16, dim)
    check(rows, got, dim)


def test_whitened_alone(spark):
    """Lengths apart; no variance, components without variance, null ids, deviations beyond a long."""
    r = np.random.default_rng(1)
    flat = [(i, [float(a), 2.0 * float(a), 5.0]) for i, a in enumerate(r.normal(size=30).round(2))]
    rows = flat + [(100, [1.0] * 5), (101, [1.0] * 5), (None, [3.0, 1.0, 5.0]), (200, [2.0**45, 1.0]), (201, [1.0, 2.0])]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    one = [r for r in got if r["vec_id"] in (100, 101)]
    assert len(one) == 10 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] == 0 for r in one)
    three = [r for r in got if r["vec_id"] == 3]
    assert [r["whitened"] is None for r in sorted(three, key=lambda r: r["component"])] == [False, False, True]
    assert sum(r["explained"] for r in three) == pytest.approx(1) and sum(r["vec_id"] is None for r in got) == 3
    far = [r for r in got if r["vec_id"] in (200, 201)]
    assert all(r["deviation"] is None and r["n"] == 2 for r in far)


def test_small_variances_keep_their_digits(spark):
    """A covariance would lose what is 1e9 times smaller than the largest deviation."""
    r = np.random.default_rng(2)
    a, b = np.floor(r.normal(size=400) * 2.0**31), r.integers(-40, 41, 400)
    rows = [(i, [float(a[i]), float(a[i] + b[i] / 64)]) for i in range(400)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    small = {r["vec_id"]: r["whitened"] for r in got if r["component"] == 2}
    lesser = np.array([small[i] for i in range(400)])
    true = (b - b.mean()) / b.std()
    slope = (a - a.mean()) @ (b - b.mean()) / ((a - a.mean()) ** 2).sum()
    rest = (b - b.mean()) - slope * (a - a.mean())
    assert abs(abs(np.corrcoef(lesser, rest)[0, 1]) - 1) < 1e-6 and abs(lesser.std() - 1) < 1e-6 and abs(true.std() - 1) < 1e-9
