"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import _folders, remove, saved


def connected_components(edges: DataFrame, most: int = 60, keep: list[str] | None = None) -> DataFrame:
    """(node, comp) for every node of (a, b): comp is the smallest node reachable.

    Each round every node and the node that it points to take the smallest label
    among the node's neighbours, then pointers are halved; rounds grow with the
    logarithm of the longest path.  Labels are written after each round;
    the folder of the last is added to ``keep``, or left until ``clear_saved``."""
    keep = _folders if keep is None else keep
    edges = edges.where("a is not null and b is not null and a <> b")
    spark, scratch, held = edges.sparkSession, [], []
    edges = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges", scratch)
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "cc-labels", held)
    for _ in range(most):
        now: list[str] = []
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        own = labels.join(near, "node")
        offers = own.select("node", F.least("comp", "near").alias("comp")).union(own.where(F.col("near") < F.col("comp")).select(F.col("comp").alias("node"), F.col("near").alias("comp")))
        # written, so that the next join's shuffles stand alone and a large component's nodes can be dealt to several tasks
        hooked = saved(offers.groupBy("node").agg(F.min("comp").alias("comp")), "cc-hooked", scratch)
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = saved(hooked.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "cc-labels", now)
        changed = after.join(labels.withColumnRenamed("comp", "old"), "node").where("comp <> old").limit(1).count()
        remove(spark, held)
        labels, held = after, now
        if not changed:
            remove(spark, scratch)
            keep.extend(held)
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
