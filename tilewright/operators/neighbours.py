"""Exact nearest neighbours by joins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import loops
from tilewright.operators.cells import cell

#: Rows of a query side that may be broadcast, checked by a count.
MOST_QUERIES = 10_000
#: Halvings of a radius.
MOST_LEVELS = 20


def _cells(x: str, y: str, size: float, up: int = 0) -> list[Column]:
    """Cells ``up`` levels above those of ``size``: they nest exactly."""
    return [F.shiftright(cell(F.col(v), size), up) for v in (x, y)]


def _start(asks: DataFrame, points: DataFrame, levels: int, k: int) -> DataFrame:
    """asks (fx, fy) with ``level``: the finest whose cell around them holds nearly half of k points."""
    counts = points.groupBy("fx", "fy").count()
    up = F.lit(levels) - F.col("level")
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    at = [F.call_function("shiftright", F.col(v), up.cast("int")).alias(v) for v in ("fx", "fy")]
    full = counts.select("*", every).select("level", *at, "count").groupBy("level", "fx", "fy").agg(F.sum("count").alias("n")).where(F.col("n") >= max(1, math.ceil(0.4 * k)))
    own = asks.select("_q", "fx", "fy", every).select("_q", "level", *at).join(full, ["level", "fx", "fy"]).groupBy("_q").agg(F.max("level").alias("level"))
    return asks.join(own, "_q", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def nearest(
    queries: DataFrame, points: DataFrame, query: str, point: str, k: int, radius: float,
    accept: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, order: Callable[[Column, Callable[[str], Column]], list[Column]] | None = None,
) -> DataFrame:
    """(query, point, d2, rank) of the k points (x, y) nearest to each query,
    strictly within ``radius``; ties go to the smaller id.

    ``accept(q, p)`` says which pairs count, by columns q("name") of queries and p("name")
    of points.  ``order(d2, p)`` gives other ranks; they never fall with d2.

    A query begins with cells about as wide as its neighbours are away, and sees its own
    and the eight around it.  Who finds k points nearer than one cell has them all; the
    others see cells of twice the width, up to the radius."""
    loops.ensure_checkpoint_dir(queries.sparkSession)
    own = [F.struct(*queries.columns).alias("_query")] if accept else []
    other = [F.struct(*points.columns).alias("_point")]
    s = points.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    room = max(s[1] or 0.0, radius / 1e6) * max(s[2] or 0.0, radius / 1e6)
    levels = min(max(math.ceil(math.log2(radius / math.sqrt(room * k / max(s[0], 1)))) + 2, 0), MOST_LEVELS)
    size = radius * (1 + 1e-9) / 2**levels
    fine = lambda x, y: [c.alias(n) for c, n in zip(_cells(x, y, size), ("fx", "fy"), strict=True)]
    rows = points.select(F.col(point).alias("_p"), "x", "y", *fine("x", "y"), *other).where("fx is not null and fy is not null").checkpoint()
    asks = queries.select(F.col(query).alias("_q"), F.col("x").alias("qx"), F.col("y").alias("qy"), *fine("x", "y"), *own).where("fx is not null and fy is not null")
    asks = _start(asks, rows, levels, k).checkpoint()
    begin = {r["level"] for r in asks.select("level").distinct().collect()}
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    by = order or (lambda d, p: [d, p(point)])
    w = Window.partitionBy("_q").orderBy(*(F.col(f"_o{n}") for n in range(len(by(F.col("d2"), lambda c: F.col("_point")[c])))))
    near = lambda v: F.explode(F.array(*[F.col(v) + d for d in (-1, 0, 1)]))
    done, waiting = None, None
    for level in range(max(begin, default=0), -1, -1):
        new = asks.where(F.col("level") == level)
        now = new if waiting is None else waiting.unionByName(new)
        up = levels - level
        reach = radius * radius if level == 0 else (radius / 2**level) ** 2 * (1 - 1e-9)
        seen = now.withColumn("cx", F.shiftright("fx", up)).withColumn("cy", F.shiftright("fy", up)).withColumn("cx", near("cx")).withColumn("cy", near("cy"))
        both = seen.drop("fx", "fy", "level").join(rows.withColumn("cx", F.shiftright("fx", up)).withColumn("cy", F.shiftright("fy", up)).drop("fx", "fy"), ["cx", "cy"])
        both = both.withColumn("d2", d2).where(F.col("d2") < reach)
        if accept:
            both = both.where(accept(lambda c: F.col("_query")[c], lambda c: F.col("_point")[c]))
        ranks = [c.alias(f"_o{n}") for n, c in enumerate(by(F.col("d2"), lambda c: F.col("_point")[c]))]
        found = both.select("_q", "_p", "d2", *ranks).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("_q", "_p", "d2", "rank")
        if level:
            found = found.checkpoint()
            whole = found.where(F.col("rank") == k).select("_q")
            waiting = now.join(whole, "_q", "left_anti").checkpoint()
            found = found.join(whole, "_q", "left_semi")
        done = found if done is None else done.unionByName(found)
    return done.select(F.col("_q").alias(query), F.col("_p").alias(point), "d2", "rank")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, d2, place) for a query set (qid, qv) of checked size against all
    vectors (vec_id, v), by true distances."""
    n = queries.count()
    if n > MOST_QUERIES:
        raise ValueError(f"{n} queries; at most {MOST_QUERIES} are compared with every vector")
    d2 = F.aggregate(F.zip_with("qv", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = vectors.crossJoin(F.broadcast(queries)).where("vec_id <> qid").select("qid", "vec_id", d2.alias("d2"))
    w = Window.partitionBy("qid").orderBy("d2", "vec_id")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("qid", "vec_id", F.round("d2", 9).alias("d2"), "place")
