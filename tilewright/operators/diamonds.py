"""Diamonds of a planar root as keys (level, x, y), and what a set of them depends on.

Places count in steps of the finest level from the root's lower corner.  A diamond of
an even level is a square cell with its centre as key, one of an odd level stands on
an edge between two such cells.  Each depends on the two diamonds whose centres are
its parent corners, as far as they lie inside the root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.bits import right
from tilewright.operators import loops

KEY = ["level", "x", "y"]


def reach(level: Column, half: int) -> Column:
    """Half the width of a diamond's cell; ``half`` is that of the root."""
    return right(F.lit(half), right(level, 1))


def locate(level: Column, x: Column, y: Column, half: int) -> tuple[Column, Column]:
    """The centre of the diamond of a level that holds a real place; the root's far
    sides belong to its last cells."""
    s = reach(level, half)

    def centre(v: Column) -> Column:
        return (F.greatest(F.lit(0), F.least(F.floor(v / (2 * s)), F.floor(half / s) - 1)) * 2 + 1) * s

    cx, cy = centre(x), centre(y)
    dx, dy, odd = x - cx, y - cy, level % 2 == 1
    across = F.abs(dx) >= F.abs(dy)
    step_x = F.when(odd & across, F.when(dx < 0, -s).otherwise(s)).otherwise(0)
    step_y = F.when(odd & ~across, F.when(dy < 0, -s).otherwise(s)).otherwise(0)
    return (cx + step_x).cast("long"), (cy + step_y).cast("long")


def parents(level: Column, x: Column, y: Column, half: int) -> Column:
    """Array of the parents (x, y) of a diamond below the root, those outside it too."""
    s, up = reach(level, half), reach(level - 1, half)

    def at(a: Column, b: Column) -> Column:
        return F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))

    # odd: along the axis on which it stands between two cells; even: the diagonal whose ends stand on edges
    flat = F.pmod(x / s, F.lit(2)) == 0
    rising = F.pmod((x - s) / up + (y - s) / up, F.lit(2)) == 1
    odd = F.when(flat, F.array(at(x - s, y), at(x + s, y))).otherwise(F.array(at(x, y - s), at(x, y + s)))
    even = F.when(rising, F.array(at(x - s, y - s), at(x + s, y + s))).otherwise(F.array(at(x - s, y + s), at(x + s, y - s)))
    return F.when(level % 2 == 1, odd).otherwise(even)


def with_parents(rows: DataFrame, half: int, keep: Sequence[str] = ()) -> DataFrame:
    """(level, x, y, parent_level, parent_x, parent_y), after the columns to keep: one
    row for each parent inside the root."""
    level = F.col("level")
    both = rows.where(level > 0).select(*keep, *KEY, F.explode(parents(level, F.col("x"), F.col("y"), half)).alias("p"))
    inside = F.col("p.x").between(0, 2 * half) & F.col("p.y").between(0, 2 * half)
    return both.where(inside).select(*keep, *KEY, (level - 1).alias("parent_level"), F.col("p.x").alias("parent_x"), F.col("p.y").alias("parent_y"))


def complete(roots: DataFrame, half: int, levels: int) -> DataFrame:
    """(root, level, x, y): every diamond of each root down to a level."""
    rows = roots.select("root", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("s", reach(F.col("level"), half))
    places = F.sequence(F.lit(0), (2 * half / F.col("s")).cast("int"))
    rows = rows.withColumn("a", F.explode(places)).withColumn("b", F.explode(places))
    a, b = F.col("a") % 2 == 1, F.col("b") % 2 == 1
    return rows.where(F.when(F.col("level") % 2 == 1, a != b).otherwise(a & b)).select("root", "level", (F.col("a") * F.col("s")).cast("long").alias("x"), (F.col("b") * F.col("s")).cast("long").alias("y"))


def needed(seeds: DataFrame, half: int, levels: int, keep: Sequence[str] = ()) -> DataFrame:
    """The seeds and all that they depend on, each once (and for each root, if the
    columns to keep name one)."""

    def up(rows: DataFrame) -> DataFrame:
        return with_parents(rows, half, keep).select(*keep, F.col("parent_level").alias("level"), F.col("parent_x").alias("x"), F.col("parent_y").alias("y"))

    return loops.closure(seeds.select(*keep, *KEY), up, levels + 1)


def blocked(nodes: DataFrame, missing: Column, half: int, levels: int) -> DataFrame:
    """Nodes without a record of their own or of anything they depend on."""
    loops.ensure_checkpoint_dir(nodes.sparkSession)
    edges = with_parents(nodes, half).checkpoint()

    def children(rows: DataFrame) -> DataFrame:
        up = rows.select(F.col("level").alias("parent_level"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"))
        return edges.join(up, ["parent_level", "parent_x", "parent_y"], "left_semi").select(*KEY)

    return loops.closure(nodes.where(missing).select(*KEY), children, levels + 1)
