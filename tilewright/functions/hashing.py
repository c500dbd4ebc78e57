"""FNV-1a over bytes, vectorised across rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(payloads: list[bytes | None]) -> list[str | None]:
    """16 lower-case hexadecimal digits for each payload; null for null."""
    lengths = np.array([len(p) if p is not None else 0 for p in payloads], np.int64)
    order = np.argsort(-lengths, kind="stable")
    state = np.full(len(payloads), OFFSET, np.uint64)
    if len(payloads) and lengths.max(initial=0):
        data = np.frombuffer(b"".join(p or b"" for p in payloads), np.uint8)
        start = np.cumsum(lengths) - lengths
        starts, sorted_lengths = start[order], lengths[order]
        live = state[order]
        for k in range(int(lengths.max())):  # one step for the k-th byte of all rows that have one
            n = int(np.searchsorted(-sorted_lengths, -k, side="left"))
            live[:n] = (live[:n] ^ data[starts[:n] + k]) * np.uint64(PRIME)
        state[order] = live
    return [None if p is None else f"{int(s):016x}" for p, s in zip(payloads, state, strict=True)]


def fnv1a64_hex(payload: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(fnv1a64(list(rows)))

    return F.pandas_udf(run, "string")(payload)
