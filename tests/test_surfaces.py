import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import diamonds, surfaces, whole_roots

HALF, N, LEVELS = 8, 4, 2
SIDE = 2 * HALF


def field(root, x, y):
    return (x * 37 + y * 91 + root * 13) % 101 * 40 - 900


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(r, x, y, field(r, x, y)) for r in (1, 2) for x in range(SIDE + 1) for y in range(SIDE + 1)], "root long, px long, py long, value long")


def roots(built):
    return built.where("level = 0").select("root", "low")


def heights_of(leaves):
    """place -> height, of both kinds of vertices."""
    out = {}
    s = surfaces.reach(LEVELS, HALF)
    for r in leaves.collect():
        for name, m, odd in (("corners", N + 1, 0), ("centres", N, 1)):
            for k, v in enumerate(r[name]):
                place = (r["root"], r["x"] - s + (k % m * 2 + odd) * s // N, r["y"] - s + (k // m * 2 + odd) * s // N)
                assert out.setdefault(place, v) == v
    return out


@pytest.mark.parametrize("tolerance", [0, 1, 7])
def test_leaves_come_back(spark, samples, tolerance):
    built = surfaces.build(samples, HALF, N, LEVELS, tolerance)
    per_root = {r["level"]: r["count"] / 2 for r in built.groupBy("level").count().collect()}
    assert per_root == {0: 1, 1: 4, 2: 4}
    patches, leaves = surfaces.synthesise(roots(built), built, HALF, N, LEVELS)
    got = heights_of(leaves)
    errors = [abs(v - field(*place)) for place, v in got.items()]
    assert max(errors) <= tolerance and (tolerance == 0 or max(errors) > 0)
    # what a level gives to its parents is what comes down again
    low = built.select(*surfaces.KEY, F.col("low").alias("given"))
    assert patches.join(low, surfaces.KEY).where("low <> given").count() == 0 or tolerance > 0
    assert patches.count() == built.count()


def test_inner_tolerance_is_bounded_by_levels(spark, samples):
    built = surfaces.build(samples, HALF, N, LEVELS, 2, inner_tolerance=2)
    _, leaves = surfaces.synthesise(roots(built), built, HALF, N, LEVELS)
    errors = [abs(v - field(*place)) for place, v in heights_of(leaves).items()]
    assert 2 < max(errors) <= 20


def test_plane_has_no_details(spark):
    rows = [(5, x, y, 3 * x - 2 * y) for x in range(SIDE + 1) for y in range(SIDE + 1)]
    built = surfaces.build(spark.createDataFrame(rows, "root long, px long, py long, value long"), HALF, N, LEVELS)
    for r in built.where("level % 2 = 0").collect():
        assert set(r["codes"]) <= {0, 1, -1}  # rounding of halves alone


def test_missing_samples_and_no_roots(spark, samples):
    one = samples.where("root = 1 and px = 4 and py = 4")
    built = surfaces.build(one, HALF, N, LEVELS, missing=-7)
    _, leaves = surfaces.synthesise(roots(built), built, HALF, N, LEVELS)
    got = heights_of(leaves)
    assert {p: v for p, v in got.items() if v != -7} == {(1, 4, 4): field(1, 4, 4)}
    assert surfaces.build(samples.where("root = 9"), HALF, N, LEVELS).count() == 0
    with pytest.raises(ValueError):
        surfaces.build(samples, HALF, N, 3)
    with pytest.raises(ValueError):
        surfaces.sampled_leaves(samples, HALF, N, 4)


def test_values_beyond_32_bits(spark, samples):
    high = samples.where("root = 1").withColumn("value", F.when((F.col("px") + F.col("py")) % 2 == 0, F.lit(2**31 - 1) * F.when(F.col("px") % 2 == 0, 1).otherwise(-1)).otherwise(0))
    built = surfaces.build(high, HALF, N, LEVELS)
    assert {r["status"] for r in built.where("level = 2").collect()} == {"overflow"}
    codes = built.where("level = 0").select("root", "level", "x", "y", F.transform("codes", lambda c: F.lit(2**31 - 1)).alias("codes"), F.lit(1000).alias("tolerance"))
    top = codes.select("root", F.array_repeat(F.lit(2**31 - 1).cast("long"), (N + 1) ** 2).alias("low"))
    patches, leaves = surfaces.synthesise(top, codes, HALF, N, LEVELS)
    assert patches.count() == 1 and leaves.count() == 0  # saturated details, then no children
    _, whole = surfaces.synthesise(top, codes, HALF, N, 0)
    assert [r["status"] for r in whole.collect()] == ["overflow"]


def test_lost_and_absent_records(spark, samples):
    """An absent record's children are smooth and keep the level of their data; a lost one's are unknown,
    and of the children of its neighbours only the own side is known, the other mirrors it."""
    built = surfaces.build(samples.where("root = 1"), HALF, N, LEVELS)
    at = (F.col("level") == 1) & (F.col("x") == 0)
    smooth = built.withColumn("codes", F.when(~at, F.col("codes")))
    patches, _ = surfaces.synthesise(roots(built), smooth, HALF, N, LEVELS)
    by = {(r["level"], r["x"], r["y"]): r for r in patches.collect()}
    assert by[2, 4, 4]["data_levels"] == [2, 1] or by[2, 4, 4]["data_levels"] == [1, 2]
    assert by[2, 12, 4]["data_levels"] == [2, 2] and len(by) == 9
    lost = built.where(~at)
    patches, leaves = surfaces.synthesise(roots(built), lost, HALF, N, LEVELS)
    half = {(r["level"], r["x"], r["y"]): r for r in patches.collect()}
    assert half[2, 12, 4]["low"] == by[2, 12, 4]["low"] and sorted(half[2, 4, 4]["known"]) == [False, True]
    grid = np.array(half[2, 4, 4]["low"]).reshape(N + 1, N + 1)
    full = np.array([r["low"] for r in built.where("level = 2 and x = 4 and y = 4").collect()][0]).reshape(N + 1, N + 1)
    rising = bool(surfaces._rising(2, np.array([4]), np.array([4]), HALF)[0])
    mirror = grid[::-1, ::-1].T if rising else grid.T
    assert (grid == mirror).all()
    assert (grid == full).sum() >= (N + 1) * (N + 2) // 2
    assert {(r["x"], r["y"]) for r in leaves.collect()} == {(12, 4), (12, 12)}


def test_answers(spark, samples):
    """Every place against interpolation in its triangle by hand, and only what is needed is read."""
    built = surfaces.build(samples, HALF, N, LEVELS)
    places = [(k, 1 + k % 2, (k * 37 % 161) / 10.0, (k * 53 % 161) / 10.0, w) for k in range(400) for w in [100.0, 6.0, 4.0, 0.1][k % 4 : k % 4 + 1]]
    asked = spark.createDataFrame(places + [(1000, 99, 1.0, 1.0, 1.0)], "id long, root long, px double, py double, wanted double")
    got = {r["id"]: r for r in surfaces.answer(asked, roots(built), built, HALF, N, LEVELS).collect()}
    assert got[1000]["state"] == "unavailable" and got[1000]["height"] is None
    patches, _ = surfaces.synthesise(roots(built), built, HALF, N, LEVELS)
    low = {(r["root"], r["level"], r["x"], r["y"]): np.array(r["low"]).reshape(N + 1, N + 1) for r in patches.collect()}
    reached = {0: 2 * 2**0.5 * 8 / 4, 1: 4.0, 2: 2 * 2**0.5 * 4 / 4}
    for k, root, px, py, wanted in places:
        r = got[k]
        assert r["level"] == r["data_level"] == min((v for v in reached if reached[v] <= wanted), default=2)
        assert r["state"] == ("ready" if reached[r["level"]] <= wanted else "limited")
        close = False
        for (o, level, x, y), patch in low.items():
            s = surfaces.reach(level, HALF)
            inside = abs(px - x) + abs(py - y) <= s if level % 2 else max(abs(px - x), abs(py - y)) <= s
            if o == root and level == r["level"] and inside:
                corners = surfaces.corners(level, HALF, N)
                rising = bool(surfaces._rising(level, np.array([x]), np.array([y]), HALF)[0])
                for j in range(N):
                    for i in range(N):
                        quad = [(j, i), (j, i + 1), (j + 1, i), (j + 1, i + 1)]
                        for left in ((0, 1, 2), (3, 1, 2)) if rising else ((1, 0, 3), (2, 0, 3)):
                            v = [quad[q] for q in left]
                            p = [corners[q] + (x, y) for q in v]
                            t = np.linalg.solve(np.array([p[1] - p[0], p[2] - p[0]], float).T, np.array([px, py]) - p[0])
                            if t.min() >= -1e-9 and t.sum() <= 1 + 1e-9:
                                h = patch[v[0]] + t[0] * (patch[v[1]] - patch[v[0]]) + t[1] * (patch[v[2]] - patch[v[0]])
                                close |= abs(h - r["height"]) < 1e-6
        assert close, (k, r)


def test_needed_only(spark, samples):
    built = surfaces.build(samples, HALF, N, LEVELS)
    wanted = diamonds.needed(spark.createDataFrame([(1, 2, 4, 4)], "root long, level int, x long, y long"), HALF, LEVELS, ["root"])
    patches, leaves = surfaces.synthesise(roots(built), built, HALF, N, LEVELS, wanted)
    assert [(r["root"], r["x"], r["y"]) for r in leaves.collect()] == [(1, 4, 4)]
    whole, _ = surfaces.synthesise(roots(built), built, HALF, N, LEVELS)
    known = patches.where("known[0] and known[1]").select(*surfaces.KEY, "low")
    assert known.exceptAll(whole.select(*surfaces.KEY, "low")).count() == 0


def test_leaves_are_filled_from_sorted_rows(spark, samples):
    """Leaves that go on in the next batch, that lie in four and that have no sample at all; nothing is collected into lists."""
    some = samples.where("root = 1 or px < 3").unionByName(spark.createDataFrame([(3, 1, 0, 5), (None, 0, 0, 7), (2, 4, 4, None)], "root long, px long, py long, value long"))
    leaves = surfaces.sampled_leaves(some, HALF, N, LEVELS, -1)
    assert "collect_list" not in leaves._jdf.queryExecution().executedPlan().toString()
    want = {}
    step, width = surfaces.reach(LEVELS, HALF) // N, 2 * N + 1
    values = {(r["root"], r["px"], r["py"]): r["value"] for r in some.collect() if r["value"] is not None}
    for root in (1, 2, 3):
        for x in (HALF // 2, 3 * HALF // 2):
            for y in (HALF // 2, 3 * HALF // 2):
                at = [(x + (b - N) * step, y + (a - N) * step) if (a + b) % 2 == 0 else None for a in range(width) for b in range(width)]
                want[root, x, y] = [values.get((root, *p), -1) if p else -1 for p in at]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("7", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert {(r["root"], r["x"], r["y"]): r["matrix"] for r in leaves.select("*").collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_whole_roots_are_as_level_by_level(spark, monkeypatch):
    """Roots built and answered whole, in one pass, agree with those that go level by level."""
    half, levels = 16, 4
    side = 2 * half
    given = spark.range(4 * (side + 1) ** 2).select((F.col("id") % 4).alias("root"), F.floor(F.col("id") / 4 % (side + 1)).cast("long").alias("px"), F.floor(F.col("id") / 4 / (side + 1)).cast("long").alias("py"))
    given = given.where("hash(root, px, py) % 5 <> 0").withColumn("value", F.expr("cast(hash(px, py, root) % 2000 as long)"))
    given = given.union(spark.createDataFrame([(7, 0, 0, 1 << 40), (8, 99, 0, 5), (None, 1, 1, 5), (9, 4, 4, None)], given.schema)).checkpoint()

    def answers():
        built = surfaces.build(given, half, N, levels, 2, missing=3)
        key = F.xxhash64("root", "level", "x", "y")
        kept = built.where(F.pmod(key, F.lit(11)) != 3).withColumn("codes", F.when(F.pmod(key, F.lit(7)) != 2, F.col("codes")))
        requests = spark.range(4000).select("id", F.when(F.col("id") % 97 > 0, F.col("id") % 11).alias("root"), F.expr("id * 7919 % 32001 / 1000.0D").alias("px"), F.expr("case when id % 89 > 0 then id * 104729 % 32001 / 1000.0D end").alias("py"), F.expr("100 * pow(2.0D, id % 5 - 1)").alias("wanted"))
        edges = spark.range(81 * 4).select((F.col("id") + 5000).alias("id"), (F.col("id") % 4).alias("root"), (F.floor(F.col("id") / 4) % 9 * 4.0).alias("px"), (F.floor(F.col("id") / 36) * 4.0).alias("py"), F.lit(1.0).alias("wanted"))
        found = surfaces.answer(requests.union(edges), kept.where("level = 0").select("root", "low"), kept, half, N, levels, 100.0)
        return sorted(map(tuple, built.select("root", "level", "x", "y", "low", "codes", "tolerance", "status").collect())), sorted(map(tuple, found.withColumn("height", F.round("height", 6)).collect()))

    whole = answers()
    calls = []
    monkeypatch.setattr(whole_roots, "SHARE", 100)
    monkeypatch.setattr(whole_roots, "AT_ONCE", 80)
    assert answers() == whole
    monkeypatch.setattr(whole_roots, "fits", lambda *_: calls.append(1))
    levelwise = answers()
    assert len(calls) == 2 and levelwise[0] == whole[0] and levelwise[1] == whole[1]
    states = {r[-1] for r in whole[1]}
    assert states == {"ready", "limited", "unavailable"} and any(r[-1] == "overflow" for r in whole[0])


def test_whole_roots_need_no_join(spark, samples):
    """However many levels, a root's records and requests meet in one shuffle."""
    built = surfaces.build(samples, HALF, N, LEVELS)
    asked = spark.createDataFrame([(1, 1, 3.0, 4.0, 1.0)], "id long, root long, px double, py double, wanted double")
    plan = surfaces.answer(asked, roots(built), built, HALF, N, LEVELS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
