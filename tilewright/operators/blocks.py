"""All asks of a group against all its members, in blocks: groups are cut into shards of
their members and slices of their asks, so that no task holds a whole group, and a
kernel gets arrays of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members and asks in one block, and asks that a kernel gets at once.
SHARD, SLICE, STEP = 2000, 4000, 256
#: Rows that may be broadcast, checked by a count.
MOST_ROWS = 50_000
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def few(rows: DataFrame) -> DataFrame:
    """For joins: broadcast behind a count, else neither side, as exploded rows are many more than Spark expects."""
    return F.broadcast(rows) if rows.count() <= MOST_ROWS else rows.hint("merge")


def meet(asks: DataFrame, members: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """Rows of ``schema`` from the groups ``g`` (long) that have both asks and members, (g, id, v)
    each, v doubles: ``kernel(ask ids, ask vs, member ids, member vs)`` gives their columns,
    of some asks and one shard of the members.  All of a side have as many doubles."""
    step = STEP
    slices = asks.groupBy("g").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).checkpoint()
    cuts = members.join(few(slices), "g").groupBy("g", "slices").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")).checkpoint()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    cuts = few(cuts)
    left = members.join(cuts, "g").select("g", one("shards").alias("shard"), every("slices").alias("slice"), F.lit(False).alias("asks"), "id", "v")
    right = asks.join(cuts, "g").select("g", every("shards").alias("shard"), one("slices").alias("slice"), F.lit(True).alias("asks"), "id", "v")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            ids, v = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5)
            ends = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                key, values = tuple(keys[lo, :3].tolist()), v.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                if key != now:
                    now, held = key, []
                if not keys[lo, 3]:
                    held.append((ids[lo:hi], values))
                elif held:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    for k in range(lo, hi, step):
                        n = min(k + step, hi)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kernel(ids[k:n], values[k - lo : n - lo], *held[0])], names=names)

    rows = left.unionByName(right).repartition("g", "shard", "slice").sortWithinPartitions("g", "shard", "slice", "asks")
    return rows.mapInArrow(run, schema)
