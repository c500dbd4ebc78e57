"""Whitening of vectors by a tall-skinny QR decomposition.

The rows of the fit list are centred by their exact sums and cut into partitions;
each is reduced to the triangle R of its QR decomposition, batch after batch, and
triangles are merged sixteen at a time until one is left.  The singular values of
the last one give the variances, its right vectors the components: no covariance
is ever formed, so small variances keep all their digits.

What grows with the table stays in Spark: the driver gets, for each length of
vectors, sums and the wanted components alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import saved

#: Integer grid: x = floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Parts that are merged at a time.
FAN = 16
#: Components at most.
COMPONENTS = 16
_LONG = 1 << 63


@dataclass
class Model:
    """Of one vector length: n rows of the fit list, their sums, unit components
    (rows, falling variance), variances, and the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as long, or as Python's integers where these don't fit."""
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max((abs(int(s)) for s in self.sums), default=0)
        if most < _LONG:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        d = self.deviations(x)
        return (d / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over the roots of their variances; nan for
        components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centred(x) @ self.components.T / np.sqrt(self.variances)
        out[:, self.variances == 0] = np.nan
        return out


def grid(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows with x, the grid places of their vector, and dim, its length, instead of
    ``vec``; without null vectors, and vectors with null, non-finite or (beyond 2^56
    steps) unstorable entries."""
    scaled = F.transform(vec, lambda c: F.floor(F.when(F.abs(c.cast("double")) < F.lit(2.0**50), c.cast("double") * STEPS)))
    rows = vectors.withColumn("x", scaled).where(F.col("x").isNotNull() & F.coalesce(F.forall("x", lambda c: c.isNotNull()), F.lit(False)))
    return rows.withColumn("x", F.transform("x", lambda c: c + F.lit(SHIFT).cast("long"))).withColumn("dim", F.size("x")).drop(vec)


def _matrices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """Batches by vector length: (dim, rows, matrix)."""
    for f in frames:
        for dim, some in f.groupby("dim"):
            if dim:
                yield int(dim), some, np.stack(some["x"].to_numpy())


def _partials(fit: DataFrame, step: Callable[[int, np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """(dim, part, m): one matrix for each partition and length, folded over its batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for dim, _, x in _matrices(frames):
            held[dim] = step(dim, held.get(dim), x)
        yield pd.DataFrame({"dim": list(held), "m": [m.tobytes() for m in held.values()]}).astype({"dim": "int32"})

    return fit.select("dim", "x").mapInPandas(run, "dim int, m binary").withColumn("part", F.spark_partition_id())


def _merged(partials: DataFrame, merge: Callable[[int, list[np.ndarray]], np.ndarray], name: str) -> DataFrame:
    """(dim, m): the parts of a length merged ``FAN`` at a time, level by level."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        dim, part = int(f["dim"].iloc[0]), int(f["part"].iloc[0]) // FAN
        parts = [np.frombuffer(m) for m in f.sort_values("part")["m"]]
        return pd.DataFrame({"dim": [dim], "part": [part], "m": [merge(dim, parts).tobytes()]}).astype({"dim": "int32", "part": "int32"})

    level = saved(partials, name)
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level = level.groupBy("dim", F.floor(F.col("part") / FAN).alias("_group")).applyInPandas(run, "dim int, part int, m binary")
        parts = -(-parts // FAN)
        if parts == 1:
            return level.select("dim", "m")


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR decomposition, (dim, dim) at most."""
    return np.linalg.qr(rows, mode="r")


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """dim -> (rows, sums by place as Python's integers)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for dim, _, x in _matrices(frames):
            safe = max(int(x.max()), -int(x.min())) * len(x) < _LONG
            n, s = held.get(dim, (0, np.zeros(dim, object)))
            held[dim] = n + len(x), s + (x if safe else x.astype(object)).sum(axis=0).astype(object)
        for dim, (n, s) in held.items():
            yield pd.DataFrame({"dim": np.full(dim, dim, np.int32), "place": np.arange(dim, dtype=np.int32), "n": n, "s": [Decimal(int(v)) for v in s]})

    rows = fit.select("dim", "x").mapInPandas(run, "dim int, place int, n long, s decimal(38,0)").groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r["dim"], (r["n"], np.zeros(r["dim"], object)))[1][r["place"]] = int(r["s"])
    return out


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """dim -> model, from distinct rows (dim, x)."""
    models = {d: Model(n, s, np.empty((0, d)), np.empty(0), 0.0) for d, (n, s) in exact_sums(fit).items()}

    def reduced(dim: int, held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        rows = models[dim].centred(x)
        return triangle(rows if held is None else np.vstack([held, rows]))

    def joined(dim: int, parts: list[np.ndarray]) -> np.ndarray:
        return triangle(np.vstack([p.reshape(-1, dim) for p in parts]))

    def decomposed(f: pd.DataFrame) -> pd.DataFrame:
        dim = int(f["dim"].iloc[0])
        _, s, vt = np.linalg.svd(np.frombuffer(f["m"].iloc[0]).reshape(-1, dim), full_matrices=True)
        s = np.concatenate([s, np.zeros(dim - len(s))])
        s[s <= s[0] * np.finfo(float).eps * dim] = 0
        v = vt[:components] * np.where(np.take_along_axis(vt, np.abs(vt).argmax(axis=1)[:, None], 1) < 0, -1, 1)[:components]
        e = s**2 / models[dim].n
        return pd.DataFrame({"dim": [dim], "vectors": [v.tobytes()], "variances": [e[:components].tobytes()], "total": [float(e.sum())]}).astype({"dim": "int32"})

    last = _merged(_partials(fit, reduced), joined, "whitening-triangles")
    for r in last.groupBy("dim").applyInPandas(decomposed, "dim int, vectors binary, variances binary, total double").collect():
        m = models[r["dim"]]
        m.components, m.variances, m.total = np.frombuffer(r["vectors"]).reshape(-1, r["dim"]), np.frombuffer(r["variances"]), r["total"]
    return models


def identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """dim -> the largest entry of the whitened fit list's covariance less the identity."""

    def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts, means and products about the mean of two parts: row 0 holds (n, 0, ...), row 1 the means."""
        n, k = a[0, 0] + b[0, 0], a.shape[1]
        d = b[1] - a[1]
        out = np.zeros((k + 2, k))
        out[0, 0], out[1] = n, a[1] + d * b[0, 0] / n
        out[2:] = a[2:] + b[2:] + np.outer(d, d) * (a[0, 0] * b[0, 0] / n)
        return out

    def counted(dim: int, held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        w = models[dim].whitened(x)[:, models[dim].variances > 0]
        part = np.zeros((w.shape[1] + 2, max(w.shape[1], 1)))
        part[0, 0] = len(w)
        if w.shape[1]:
            part[1] = w.mean(axis=0)
            part[2:] = (w - part[1]).T @ (w - part[1])
        return part if held is None else combined(held, part)

    def joined(dim: int, parts: list[np.ndarray]) -> np.ndarray:
        k = max(int((models[dim].variances > 0).sum()), 1)
        out = parts[0].reshape(-1, k)
        for p in parts[1:]:
            out = combined(out, p.reshape(-1, k))
        return out

    found = {}
    for r in _merged(_partials(fit, counted), joined, "whitening-moments").collect():
        k = int((models[r["dim"]].variances > 0).sum())
        m = np.frombuffer(r["m"]).reshape(-1, max(k, 1))
        found[r["dim"]] = float(np.abs(m[2:] / m[0, 0] - np.eye(k)).max()) if k else 0.0
    return found


ANSWER = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each vector on the first ``components`` components of the distinct vectors'
    covariance: vec_id, component (from 1), n (distinct vectors), deviation (sum of
    (n * x - S)^2, null where it isn't a long), whitened (null for a component without
    variance), explained (its share of the variance, null if there is none at all) and
    identity_error (0 if no component has variance).

    Null vectors and those with null or non-finite entries, or entries of 2^50 and
    more, take no part.  Repeated rows each get their rows and count once in the fit
    list, null ids are kept, empty vectors have no component, vectors of each length
    have a model of their own; further columns are not read and may have any name; an
    empty table gives no rows."""
    rows = saved(grid(vectors.select("vec_id", "embedding")), "whitening-rows")
    fit = saved(rows.select("dim", "x").distinct(), "whitening-fit")
    models = fitted(fit, components)
    errors = identity_errors(fit, models)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, f, x in _matrices(frames):
            m = models[dim]
            k = len(m.variances)
            d = m.deviations(x)
            if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * dim >= _LONG:
                d = d.astype(object)
            squares = (d * d).sum(axis=1)
            far = pd.array([int(s) if s < _LONG else None for s in squares], dtype="Int64")
            w = m.whitened(x)
            share = m.variances / m.total if m.total else np.full(k, np.nan)
            yield pd.DataFrame({
                "vec_id": f["vec_id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(f)), "n": np.int64(m.n),
                "deviation": far.repeat(k), "whitened": w.ravel(), "explained": np.tile(share, len(f)), "identity_error": errors[dim],
            })

    out = rows.select("vec_id", "dim", "x").mapInPandas(run, ANSWER)
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("vec_id", "component", "n", "deviation", number("whitened"), number("explained"), "identity_error")
