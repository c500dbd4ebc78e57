"""Frontier loops over DataFrames, with their lineage cut by reliable checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir; only in local mode, where it is
    unset, a temporary folder is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tilewright-")
    sc.setCheckpointDir(root)


def closure(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """All rows reachable from ``seed`` by ``step``, distinct.  Each round works on
    the rows that are new, and stops when there are none."""
    ensure_checkpoint_dir(seed.sparkSession)
    done = seed.distinct().checkpoint()
    fresh = done
    for _ in range(most):
        fresh = step(fresh).distinct().join(done, done.columns, "left_anti").checkpoint()
        if not fresh.head(1):
            return done
        done = done.unionByName(fresh)
    raise RuntimeError(f"not closed after {most} rounds")


def fixpoint(rows: DataFrame, step: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """Applies ``step`` until the rows stay the same."""
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()
    for _ in range(most):
        after = step(rows).checkpoint()
        if not after.exceptAll(rows).head(1) and not rows.exceptAll(after).head(1):
            return after
        rows = after
    raise RuntimeError(f"no fixed point after {most} rounds")
