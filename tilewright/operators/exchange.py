"""Cuts under a budget: leaves of a tree of errors are split while they fit, and then
only against groups of siblings elsewhere whose merging costs less.

In each round the splits of a view, worst first, and the merges, cheapest first, meet:
both are running sums of leaves, and a split is paid by the merges whose sum covers its
own.  It is done if even the dearest of these is a fair exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.bits import right
from tilewright.operators import loops, ranks

NODE = ["level", "row", "col"]
#: A merge is worth less than a split if its error is under this share of the split's.
FAIR = 0.8


def _up(rows: DataFrame) -> DataFrame:
    """Rows with p_level, p_row, p_col, their parent's place."""
    return rows.withColumns({"p_level": F.col("level") - 1, "p_row": right(F.col("row"), 1), "p_col": right(F.col("col"), 1)})


_PARENT = ["p_level", "p_row", "p_col"]


def fair(merged: Column, split: Column, target: float) -> Column:
    """Whether leaving a node with the error ``merged`` may pay for a split one."""
    return ((merged <= target) & (split > target)) | (merged < FAIR * split)


def step(leaves: DataFrame, nodes: DataFrame, target: float) -> tuple[DataFrame, DataFrame]:
    """(splits, merges) of one round, as (view, level, row, col) of the nodes split, and
    of those whose children are merged.

    leaves (view, budget, level, row, col, error); nodes (level, row, col, error, kids):
    a node has one to four children, none at the last level, and none with a larger error."""
    held = leaves.groupBy("view", "budget").agg(F.count("*").alias("held"))
    splits = leaves.where(F.col("error") > target).join(nodes.where("kids > 0").select(*NODE, "kids"), NODE).select("view", *NODE, "error", "kids")
    splits = ranks.placed(splits, ["view"], [F.desc("error"), *NODE], F.col("kids") - 1).drop("total")
    siblings = _up(leaves.where("level > 0")).groupBy("view", *_PARENT).agg(F.count("*").alias("n"))
    above = nodes.select(*(F.col(c).alias(p) for c, p in zip(NODE, _PARENT, strict=True)), F.col("error").alias("merged"), "kids")
    merges = siblings.join(above, _PARENT).where("n = kids and n > 1").select("view", *_PARENT, "merged", (F.col("n") - 1).alias("gain"))
    merges = ranks.placed(merges, ["view"], ["merged", *_PARENT], F.col("gain")).drop("total").withColumnRenamed("place", "donor").withColumnRenamed("upto", "freed")
    units = merges.select("view", "merged", "donor", F.explode(F.sequence(F.col("freed") - F.col("gain") + 1, "freed")).alias("unit"))  # three at most
    asked = splits.join(held, "view").withColumn("unit", F.col("upto") - (F.col("budget") - F.col("held")))
    paid = asked.join(units, ["view", "unit"], "left")
    fine = (F.col("unit") <= 0) | F.coalesce(fair(F.col("merged"), F.col("error"), target), F.lit(False))
    paid = paid.withColumn("fine", fine).checkpoint()
    ends = paid.groupBy("view").agg(F.min(F.when(~F.col("fine"), F.col("place"))).alias("end"))
    done = paid.join(ends, "view").where(F.col("end").isNull() | (F.col("place") < F.col("end")))
    used = done.groupBy("view").agg(F.max(F.when(F.col("unit") > 0, F.col("donor"))).alias("used"))
    given = merges.join(used, "view").where("donor <= used").select("view", *(F.col(p).alias(c) for c, p in zip(NODE, _PARENT, strict=True)))
    return done.select("view", *NODE), given


def exchange(leaves: DataFrame, nodes: DataFrame, target: float, rounds: int) -> DataFrame:
    """The leaves (view, budget, level, row, col, error) after at most ``rounds`` rounds,
    or once nothing is split any more.  No view ever has more leaves than its budget,
    unless it began with more."""
    loops.ensure_checkpoint_dir(leaves.sparkSession)
    columns = ["view", "budget", *NODE, "error"]
    leaves = leaves.select(*columns).checkpoint()
    for _ in range(rounds):
        splits, merges = step(leaves, nodes, target)
        splits, merges = splits.checkpoint(), merges.checkpoint()
        if not splits.head(1):
            break
        per = leaves.select("view", "budget").distinct()
        named = [F.col(c).alias(p) for c, p in zip(NODE, _PARENT, strict=True)]
        kids = splits.select("view", *named).join(_up(nodes.where("level > 0")), _PARENT).select("view", *NODE, "error")
        tops = merges.join(nodes.select(*NODE, "error"), NODE).select("view", *NODE, "error")
        stay = _up(leaves.join(splits, ["view", *NODE], "left_anti")).join(merges.select("view", *named), ["view", *_PARENT], "left_anti")
        leaves = stay.select(*columns).unionByName(kids.unionByName(tops).join(per, "view").select(*columns)).checkpoint()
    return leaves
