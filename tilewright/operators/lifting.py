"""Two-dimensional lifting of height patches: prediction of cell centres from their
corners, and update of the corners, in integers, so that it inverts exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def rounded(v: np.ndarray, divisor: int) -> np.ndarray:
    """v / divisor rounded to nearest, halves away from zero."""
    half = divisor // 2
    return np.where(v > 0, (v + half) // divisor, -((-v + half) // divisor))


def predict(corners: np.ndarray) -> np.ndarray:
    """Centres (..., n, n) from corners (..., n + 1, n + 1): ten times the four nearest
    less the eight around them, by 32, inside; the mean of four along the border."""
    p = corners.astype(np.int64)
    near = p[..., :-1, :-1] + p[..., :-1, 1:] + p[..., 1:, :-1] + p[..., 1:, 1:]
    out = rounded(near, 4)
    if p.shape[-1] > 3:
        ring = p[..., :-3, 1:-2] + p[..., :-3, 2:-1] + p[..., 1:-2, :-3] + p[..., 2:-1, :-3] + p[..., 1:-2, 3:] + p[..., 2:-1, 3:] + p[..., 3:, 1:-2] + p[..., 3:, 2:-1]
        out[..., 1:-1, 1:-1] = rounded(10 * near[..., 1:-1, 1:-1] - ring, 32)
    return out


def update(details: np.ndarray) -> np.ndarray:
    """What the corners gain from details (..., n, n): half the mean of four, none along the border."""
    d = details.astype(np.int64)
    out = np.zeros((*d.shape[:-2], d.shape[-2] + 1, d.shape[-1] + 1), np.int64)
    out[..., 1:-1, 1:-1] = rounded(d[..., :-1, :-1] + d[..., :-1, 1:] + d[..., 1:, :-1] + d[..., 1:, 1:], 8)
    return out


def analyse(corners: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, details)"""
    details = centres - predict(corners)
    return corners + update(details), details


def synthesise(low: np.ndarray, details: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, centres); raises OverflowError beyond 32 bits."""
    corners = low - update(details)
    centres = details + predict(corners)
    for a in (corners, centres):
        if len(a) and (a.min() < -(2**31) or a.max() >= 2**31):
            raise OverflowError("height beyond 32 bits")
    return corners, centres


def quantise(details: np.ndarray, tolerance: int) -> np.ndarray:
    return rounded(details, 2 * tolerance + 1)


def dequantise(codes: np.ndarray, tolerance: int) -> np.ndarray:
    """Saturates at 32 bits."""
    return np.clip(codes.astype(np.int64) * (2 * tolerance + 1), -(2**31), 2**31 - 1)


def lift_patches(patches: DataFrame, tolerance: int = 0) -> DataFrame:
    """patches (patch, corners array, centres array) of square patches: the patch with
    its low part, its quantised details, and the largest error after synthesis."""

    schema = pa.schema([("patch", pa.int64()), ("low", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64())), ("error", pa.int64())])

    def lists(values: np.ndarray) -> pa.Array:
        rows = values.reshape(len(values), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("centres").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):  # all patches of one size at once
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                n = int(round(length**0.5))
                p = part.column("corners").flatten().to_numpy().astype(np.int64).reshape(-1, n + 1, n + 1)
                q = part.column("centres").flatten().to_numpy().astype(np.int64).reshape(-1, n, n)
                low, details = analyse(p, q)
                codes = quantise(details, tolerance)
                back = synthesise(low, dequantise(codes, tolerance))
                error = np.maximum(np.abs(back[0] - p).max(axis=(1, 2)), np.abs(back[1] - q).max(axis=(1, 2)))
                yield pa.RecordBatch.from_arrays([part.column("patch").cast(pa.int64()), lists(low), lists(codes), pa.array(error)], schema=schema)

    return patches.select("patch", "corners", "centres").mapInArrow(run, "patch long, low array<long>, codes array<long>, error long")
