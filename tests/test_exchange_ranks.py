import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import exchange, ranks


def tree(seed, levels):
    """node -> error of a quadtree with holes, errors falling."""
    r = random.Random(seed)
    out = {(0, 0, c): r.uniform(1, 9) * (0.02 if c == 0 else 1) for c in range(4)}
    for level in range(levels):
        for (v, row, col), e in [x for x in out.items() if x[0][0] == level]:
            for k in r.sample(range(4), r.randrange(1, 5)):
                out[v + 1, 2 * row + k // 2, 2 * col + k % 2] = e * r.uniform(0.2, 1)
    return out


def kids(nodes, n):
    return [c for k in range(4) if (c := (n[0] + 1, 2 * n[1] + k // 2, 2 * n[2] + k % 2)) in nodes]


def rounds(nodes, leaves, budget, target, most):
    """The rule by hand: worst splits against cheapest merges, one by one."""
    leaves = set(leaves)
    for _ in range(most):
        splits = sorted((n for n in leaves if nodes[n] > target and kids(nodes, n)), key=lambda n: (-nodes[n], n))
        merges = sorted((n for n in nodes if len(kids(nodes, n)) > 1 and all(c in leaves for c in kids(nodes, n))), key=lambda n: (nodes[n], n))
        spare, cost, freed, used, done = budget - len(leaves), 0, 0, 0, []
        for n in splits:
            cost += len(kids(nodes, n)) - 1
            need, j = cost - spare, used
            gain = freed
            while gain < need and j < len(merges):
                gain += len(kids(nodes, merges[j])) - 1
                j += 1
            if need > 0:
                dearest = nodes[merges[j - 1]] if gain >= need and j else None
                if dearest is None or not ((dearest <= target < nodes[n]) or dearest < 0.8 * nodes[n]):
                    break
            used, freed = j, gain
            done.append(n)
        if not done:
            break
        for n in done:
            leaves = leaves - {n} | set(kids(nodes, n))
        for n in merges[:used]:
            leaves = leaves - set(kids(nodes, n)) | {n}
    return leaves


@pytest.mark.parametrize("target", [0.0, 0.6])
def test_exchange(spark, target):
    nodes = tree(3, 5)
    cuts = {v: [n for n in nodes if n[0] == v % 4 or n[0] < v % 4 and not kids(nodes, n)] for v in range(6)}
    cuts[6] = [n for n in nodes if n[0] == 3 and n[2] < 8 or n[0] == 0 and n[2] > 0 or n[0] < 3 and n[2] >> n[0] == 0 and not kids(nodes, n)]  # fine where it needn't be
    budgets = {v: [len(c), len(c) + 5, len(c) + 40, 20, len(c) + 1, len(nodes), len(c)][v] for v, c in cuts.items()}
    rows = spark.createDataFrame([(*n, e, len(kids(nodes, n))) for n, e in nodes.items()], "level int, row int, col int, error double, kids int")
    leaves = spark.createDataFrame([(v, budgets[v], *n, nodes[n]) for v, c in cuts.items() for n in c], "view long, budget long, level int, row int, col int, error double")
    for most in (1, 4):
        got = {}
        for r in exchange.exchange(leaves, rows, target, most).collect():
            got.setdefault(r["view"], []).append((r["level"], r["row"], r["col"]))
        for v, c in cuts.items():
            assert len(got[v]) == len(set(got[v])) <= max(budgets[v], len(c))
            assert set(got[v]) == rounds(nodes, c, budgets[v], target, most), (v, most)
    splits, merges = exchange.step(leaves, rows, target)
    assert splits.count() > 0 and merges.count() > 0


def test_exchange_of_nothing(spark):
    rows = spark.createDataFrame([], "level int, row int, col int, error double, kids int")
    leaves = spark.createDataFrame([], "view long, budget long, level int, row int, col int, error double")
    assert exchange.exchange(leaves, rows, 0.1, 3).count() == 0


def test_places(spark):
    """One group with most rows, a null group, ties in all but the last key, weights, other columns."""
    r = random.Random(5)
    rows = [("hot" if k % 3 else r.choice(["a", None]), r.randrange(5), k, k % 4) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, k int, w int").withColumn("total2", F.lit(1)).repartition(7)
    got = ranks.placed(df, ["g"], [F.desc("v"), "k"], F.col("w")).collect()
    want = {}
    for g in ("hot", "a", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        upto = 0
        for place, x in enumerate(mine, 1):
            upto += x[3]
            want[x[2]] = (place, len(mine), upto)
    assert {x["k"]: (x["place"], x["total"], x["upto"]) for x in got} == want
    assert ranks.placed(df.limit(0), ["g"], ["k"]).count() == 0
    alone = ranks.placed(df, [], ["v", "k"]).collect()
    order = sorted(rows, key=lambda x: (x[1], x[2]))
    assert {x["k"]: x["place"] for x in alone} == {x[2]: n for n, x in enumerate(order, 1)}


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_rolling(spark, width):
    r = random.Random(width)
    rows = [("g" if k % 5 else "h", k, r.random()) for k in range(700)]
    got = {x["k"]: x["top"] for x in ranks.rolling(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], ["k"], width, F.col("v"), "top").collect()}
    for g in "gh":
        mine = [x for x in rows if x[0] == g]
        for n, x in enumerate(mine):
            assert got[x[1]] == max(y[2] for y in mine[max(0, n - width + 1) : n + 1])


def test_tree_is_made_once(spark, monkeypatch):
    """No round reads the customers again; writing a checkpoint may compute it twice."""
    from tilewright.plans import exchange as plan

    seen, source = spark.sparkContext.accumulator(0), plan.customers

    def counted(spark, folder):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f

        rows = source(spark, folder).select("lon", "lat", "weight")
        return rows.mapInPandas(run, rows.schema)

    monkeypatch.setattr(plan, "customers", counted)
    folder = "/root/testdata/sf0.001"
    assert plan.exchanged_cut(spark, folder).count() > 0
    assert seen.value <= 2 * source(spark, folder).count()
