"""Exact distances from points to a surface of triangles, without a fixed radius.

First each point gets a bound: cells around it, doubled until one of them holds a
triangle's corner.  Triangles are grouped by the cell of their middle; cells are as large
as a quarter of the bound (larger for larger triangles), so the number of groups within
it doesn't depend on it.  The triangles of the nearest group give a much better bound,
and only those of groups within that are tried: whole blocks of points and triangles at
once, by products of matrices, which leave few pairs for the exact distance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import blocks, loops

AXES = ("x", "y", "z")
#: Cells between a point and its bound on each side.
REACH = 4


def _segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    length = (d * d).sum(axis=1)
    t = np.clip(((p - a) * d).sum(axis=1) / np.where(length == 0, 1, length), 0, 1)
    return np.sqrt(((p - a - t[:, None] * d) ** 2).sum(axis=1))


def distances(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of points (n, 3) to triangles (n, 3, 3): to the plane where the point stands over
    the triangle, else to the nearest edge.  Triangles may be lines or points."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    normal = np.cross(b - a, c - a)
    size = np.sqrt((normal * normal).sum(axis=1))
    over = size > 0
    for u, v in ((a, b), (b, c), (c, a)):
        over &= (np.cross(v - u, p - u) * normal).sum(axis=1) >= 0
    edges = np.minimum(np.minimum(_segment(p, a, b), _segment(p, b, c)), _segment(p, c, a))
    plane = np.abs(((p - a) * normal).sum(axis=1)) / np.where(size == 0, 1, size)
    return np.where(over, plane, edges)


def _rough(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(n, m): squares of the distances of points (n, 3) to triangles (m, 3, 3) but for rounding,
    by products of all with all.  Thin triangles get 0."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    normal = np.cross(b - a, c - a)
    size = np.sqrt((normal * normal).sum(axis=1))
    flat = size > 1e-6 * np.max([((v - u) ** 2).sum(axis=1) for u, v in ((a, b), (b, c), (c, a))], axis=0)
    normal = np.where(flat[:, None], normal / np.where(flat, size, 1)[:, None], 0)

    def along(way: np.ndarray, start: np.ndarray) -> np.ndarray:
        return p @ way.T - (way * start).sum(axis=1)

    over, side = np.ones((len(p), len(t)), bool), np.full((len(p), len(t)), np.inf)
    for u, v in ((a, b), (b, c), (c, a)):
        way = v - u
        length = np.sqrt((way * way).sum(axis=1))
        way = way / np.where(length == 0, 1, length)[:, None]
        out, on = along(np.cross(way, normal), u), along(way, u)
        over &= out <= 0
        on -= np.clip(on, 0, length)
        np.minimum(side, out * out + on * on, out=side)
    side[over] = 0
    plane = along(normal, a)
    return np.where(flat, side + plane * plane, 0)


def _best(ids: np.ndarray, p: np.ndarray, names: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, triangle, distance) of the nearest triangle of a block to each of its points."""
    t = t.reshape(-1, 3, 3)
    middle = t.reshape(-1, 3).mean(axis=0)
    room = 1e-8 * (np.abs(t - middle).max() + np.abs(p - middle).max(axis=1))  # for rounding
    near = _rough(p - middle, t - middle)
    most = distances(p, t[near.argmin(axis=1)])
    at, which = np.nonzero(near <= ((most + room) ** 2)[:, None])
    d = distances(p[at], t[which])
    order = np.lexsort((names[which], d, at))
    first = order[np.searchsorted(at[order], np.arange(len(p)))]
    return ids, names[which[first]], d[first]


def _search(asks: DataFrame, members: DataFrame) -> DataFrame:
    """(id, triangle, distance) of the nearest triangles of the groups ``g`` that points
    (g, id, x, y, z) ask, one at least; ``members`` are (g, triangle, t)."""
    asks, members = asks.select("g", "id", F.array(*AXES).alias("v")), members.select("g", F.col("triangle").alias("id"), F.col("t").alias("v"))
    return blocks.meet(asks, members, _best, "id long, triangle long, distance double")


def _spread(rows: DataFrame) -> DataFrame:
    """Dealt out, as each row is exploded; by a number, which Spark keeps also for small tables."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "id")


def _size(level: Column, size: float) -> Column:
    return F.pow(F.lit(2.0), level) * size


def _around(v: str, size: Column, reach: int) -> Column:
    at = F.floor(F.col(v) / size)
    return F.explode(F.sequence(at - reach, at + reach))


def bounds(points: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """Points with ``bound``, no less than their distance: that to the first corner of
    some triangle in the cells beside their own, on the first level that has any."""
    first = triangles.select(*(F.col("t")[k].alias(a) for k, a in enumerate(AXES))).checkpoint()
    waiting, level, done = _spread(points).checkpoint(), 0, None
    while waiting.head(1):
        s = size * 2.0**level
        cells = first.groupBy(*(F.floor(F.col(a) / s).alias(f"c{a}") for a in AXES)).agg(F.first(F.struct(*AXES)).alias("corner")).checkpoint()
        asked = waiting
        for a in AXES:
            asked = asked.withColumn(f"c{a}", _around(a, F.lit(s), 1))
        gap = sum(((F.col(a) - F.col("corner")[a]) ** 2 for a in AXES), F.lit(0.0))
        found = asked.join(blocks.few(cells), [f"c{a}" for a in AXES]).groupBy("id").agg(F.sqrt(F.min(gap)).alias("bound"))
        out = waiting.join(found, "id").checkpoint()
        done = out if done is None else done.unionByName(out)
        waiting = waiting.join(found, "id", "left_anti").checkpoint()
        level += 1
    return points.withColumn("bound", F.lit(None).cast("double")).limit(0) if done is None else done


def nearest(points: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """(id, triangle, distance): for each point (id, x, y, z) the nearest of the triangles
    (triangle, t: nine values), ties to the smaller; ``size`` is about a triangle's width.
    No rows without triangles."""
    loops.ensure_checkpoint_dir(points.sparkSession)
    if not triangles.head(1):
        return points.select("id", F.lit(None).cast("long").alias("triangle"), F.lit(None).cast("double").alias("distance")).limit(0)
    asked = bounds(points.select("id", *AXES), triangles, size)
    asked = asked.withColumn("bound", F.col("bound") * (1 + 1e-12))
    asked = asked.withColumn("level", F.greatest(F.ceil(F.log2(F.greatest(F.col("bound"), F.lit(size * 1e-9)) / (size * REACH))), F.lit(0)).cast("int"))
    asked = _spread(asked).checkpoint()
    levels = sorted(r["level"] for r in asked.select("level").distinct().collect())  # one for each doubling of the distances
    if not levels:
        return points.select("id", F.lit(None).cast("long").alias("triangle"), F.lit(None).cast("double").alias("distance")).limit(0)
    # groups of triangles that are no wider than a cell, by the cell of their middle: none reaches farther out than half a cell
    ends = {a: [F.col("t")[k + 3 * n] for n in range(3)] for k, a in enumerate(AXES)}
    boxed = triangles.select("triangle", "t", *(f(*e).alias(f"{name}{a}") for a, e in ends.items() for name, f in (("lo", F.least), ("hi", F.greatest))))
    wide = F.greatest(*(F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES))
    boxed = boxed.withColumn("own", F.greatest(F.ceil(F.log2(F.greatest(wide, F.lit(size * 1e-9)) / size)), F.lit(0)).cast("int"))
    widths = sorted(r["own"] for r in boxed.select("own").distinct().collect())  # one for each doubling of the widths
    placed = boxed.repartition("triangle").withColumn("level", F.explode(F.array(*(F.lit(v) for v in levels)))).withColumn("at", F.greatest("own", "level"))
    s = _size(F.col("at"), size)
    key = ["level", "at", *(f"c{a}" for a in AXES)]
    placed = placed.withColumns({f"c{a}": F.floor((F.col(f"lo{a}") + F.col(f"hi{a}")) / (2 * s)) for a in AXES})
    groups = placed.groupBy(*key).agg(*(F.min(f"lo{a}").alias(f"lo{a}") for a in AXES), *(F.max(f"hi{a}").alias(f"hi{a}") for a in AXES)).checkpoint()
    groups = blocks.few(groups.withColumn("g", F.monotonically_increasing_id()).checkpoint())
    members = placed.select(*key, "triangle", "t").join(groups.select(*key, "g"), key).select("g", "triangle", "t")
    near = asked.withColumn("at", F.explode(F.array_distinct(F.transform(F.array(*(F.lit(v) for v in widths)), lambda w: F.greatest(w, F.col("level"))))))
    gap = F.lit(0.0)
    for a in AXES:
        near = near.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(a) - F.col("bound")) / s - 0.51), F.floor((F.col(a) + F.col("bound")) / s + 0.51))))
        gap = gap + F.greatest((F.col(f"c{a}") - 0.51) * s - F.col(a), F.col(a) - (F.col(f"c{a}") + 1.51) * s, F.lit(0.0)) ** 2
        near = near.where(F.sqrt(gap) <= F.col("bound") * (1 + 1e-9))
    gap = F.sqrt(sum((F.greatest(F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"), F.lit(0.0)) ** 2 for a in AXES), F.lit(0.0)))
    middle = sum(((F.col(f"lo{a}") + F.col(f"hi{a}") - 2 * F.col(a)) ** 2 for a in AXES), F.lit(0.0))
    near = near.join(groups, key).withColumn("gap", gap).where(F.col("gap") <= F.col("bound") * (1 + 1e-9)).select("id", *AXES, "g", "gap", middle.alias("middle")).checkpoint()
    first = near.groupBy("id", *AXES).agg(F.min(F.struct("middle", "g")).alias("first")).select("id", *AXES, "first.g")
    found = _search(first, members).groupBy("id").agg(F.min(F.struct("distance", "triangle")).alias("best")).checkpoint()
    again = near.join(first.select("id", "g"), ["id", "g"], "left_anti").join(found.hint("merge"), "id").where(F.col("gap") <= F.col("best.distance") * (1 + 1e-9)).select("g", "id", *AXES).checkpoint()
    found = found.unionByName(_search(again, members).select("id", F.struct("distance", "triangle").alias("best")))
    return found.groupBy("id").agg(F.min("best").alias("best")).select("id", "best.triangle", "best.distance")
