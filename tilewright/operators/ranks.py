"""Places and running sums in an order, without one task for a whole group.

Rows are dealt out by ranges of the order, sorted within, and counted on from the sizes
of the ranges before; so a group with a third of all rows is ordered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import loops

_AT = (1 << 33) - 1


def placed(rows: DataFrame, group: list[str], order: list[Column | str], weight: Column | None = None) -> DataFrame:
    """Rows with ``place`` (from 1) in their group, ``total`` (its rows), and with a
    weight ``upto``, the weights' sum up to this place.  Rows that agree in all of the
    order are placed in any way, so the order should name a key."""
    loops.ensure_checkpoint_dir(rows.sparkSession)
    keys = [F.col(c) for c in group]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # numbers count on within a partition, in its order
    dealt = dealt.withColumn("_weight", F.lit(0) if weight is None else weight).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_AT))).checkpoint()
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sizes = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.sum("_weight").alias("_sum"))
    starts = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.col("_part").alias("_of_part"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_done"), F.sum("_n").over(whole).alias("total"))
    same = F.col("_part") == F.col("_of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = dealt.join(starts, same).withColumn("place", F.col("_start") + F.col("_at") - F.col("_first") + 1)
    out = out.select(*rows.columns, "_part", "_at", "_weight", "_done", "place", "total")
    if weight is not None:
        inside = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("upto", F.col("_done") + F.sum("_weight").over(inside))
    return out.drop("_part", "_at", "_weight", "_done")


def rolling(rows: DataFrame, group: list[str], order: list[Column | str], width: int, value: Column, name: str) -> DataFrame:
    """Rows with the maximum of ``value`` over each row and the ``width - 1`` before it
    in its group: slices of ``width`` rows, each with the slice before beside it."""
    inside = placed(rows, group, order).drop("total").withColumn("_slice", F.floor((F.col("place") - 1) / width)).withColumn("_value", value)
    both = inside.withColumn("_of", F.explode(F.array("_slice", F.col("_slice") + 1)))
    w = Window.partitionBy(*group, "_of").orderBy("place").rowsBetween(1 - width, 0)
    return both.withColumn(name, F.max("_value").over(w)).where(F.col("_of") == F.col("_slice")).select(*rows.columns, name)
