"""Boxes that may be the best one over a point, without trying all that lie over it.

A cell that one box covers whole bounds what any point in it gets: boxes that are worse
wherever they reach in that cell go, the others go on to its four quarters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import loops
from tilewright.operators.cells import cell, cover

#: Cells whose bounds may be broadcast, checked by a count.
MOST_CELLS = 200_000
Bounds = Callable[[Column, Column, Column, Column], tuple[Column, Column, Column]]


def inside(x0: Column, y0: Column, x1: Column, y1: Column, within: float = 0.0) -> Column:
    """Whether a cell lies within a box (west, south, east, north), that far from its edges at least."""
    return (x0 >= F.col("west") + within) & (x1 <= F.col("east") - within) & (y0 >= F.col("south") + within) & (y1 <= F.col("north") - within)


def candidates(points: DataFrame, boxes: DataFrame, box: str, size: float, halvings: int, bounds: Bounds, ties: bool = True) -> DataFrame:
    """points (lon, lat, ...) with boxes (``box``, west, south, east, north, ...): of those
    that hold a point all that may have the smallest score there, and perhaps others.

    ``bounds(x0, y0, x1, y1)`` gives, for a box in a closed cell, whether it counts for
    every point of the cell, and the least and the largest score that it has where it
    counts.  Without ``ties`` any one of the best boxes is enough.  Cells begin with
    ``size`` and are halved."""
    loops.ensure_checkpoint_dir(points.sparkSession)
    least = size / 2**halvings
    rows = points.withColumn("cx", cell(F.col("lon"), least)).withColumn("cy", cell(F.col("lat"), least))
    asked = rows.select("cx", "cy").distinct().checkpoint()
    now = cover(boxes.repartition(box), size).withColumnsRenamed({"cell_x": "cx", "cell_y": "cy"})
    for n in range(halvings + 1):
        s, up = size / 2**n, halvings - n
        if n:
            for c in ("cx", "cy"):
                now = now.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)))
        x0, y0, x1, y1 = F.col("cx") * s, F.col("cy") * s, (F.col("cx") + 1) * s, (F.col("cy") + 1) * s
        now = now.where((x0 <= F.col("east")) & (x1 >= F.col("west")) & (y0 <= F.col("north")) & (y1 >= F.col("south")))
        whole, low, high = bounds(x0, y0, x1, y1)
        best = now.where(whole).select("cx", "cy", high.alias("high"), F.col(box).alias("by")).groupBy("cx", "cy").agg(F.min(F.struct("high", "by")).alias("best"))
        wanted = asked.select(F.shiftright("cx", up).alias("cx"), F.shiftright("cy", up).alias("cy")).distinct().join(best, ["cx", "cy"], "left").checkpoint()
        if wanted.count() <= MOST_CELLS:
            wanted = F.broadcast(wanted)
        keep = F.col("best").isNull() | (F.col(box) == F.col("best.by")) | (low <= F.col("best.high") if ties else low < F.col("best.high"))
        now = now.join(wanted, ["cx", "cy"]).where(keep).drop("best").checkpoint()
    return rows.join(now, ["cx", "cy"]).drop("cx", "cy")
