"""Height surfaces of roots that a task can hold whole, as dense arrays of many roots at a time.

A root's diamonds and samples are bounded by its ``half``, ``n`` and ``levels``, not by
the tables.  Where they are few (``fits``), rows are dealt out and sorted by root, and
all levels are built, or read and answered, in one pass over them, without a shuffle or
a checkpoint for each level.  Larger roots go level by level (``surfaces``), with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import lifting, surfaces

#: Diamonds of a root that is held whole, and of all roots that a kernel works on at once.
MOST, AT_ONCE = 2048, 1 << 16
#: Requests for one root that one task answers; more are dealt to several.
SHARE = 200_000


@cache
def centres(level: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """((d, 2) centres of a level's diamonds, their index by x and y in steps of the level, -1 where there is none)."""
    s = surfaces.reach(level, half)
    a, b = np.mgrid[: 2 * half // s + 1, : 2 * half // s + 1]
    held = (a % 2 != b % 2) if level % 2 else (a % 2 == 1) & (b % 2 == 1)
    index = np.full(a.shape, -1, np.int64)
    index[held] = np.arange(held.sum())
    return np.stack([a[held] * s, b[held] * s], axis=1), index


def fits(half: int, levels: int) -> bool:
    return sum((2 * half // surfaces.reach(k, half) + 1) ** 2 for k in range(levels + 1)) <= 4 * MOST


@cache
def _places(level: int, half: int, n: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat places, in steps, of a level's corners (d, (n + 1)^2) and centres (d, n^2), those
    outside the root mirrored at its border, and which corners lie inside."""
    d, corner = centres(level, half)[0], surfaces.corners(level, half, n)
    middle = (corner[:-1, :-1] + corner[1:, 1:]) // 2

    def flat(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = d[:, None, :] + offsets.reshape(-1, 2)[None]
        inside = ((at >= 0) & (at <= 2 * half)).all(axis=2)
        at = np.where(at < 0, -at, np.where(at > 2 * half, 4 * half - at, at)) // step
        return at[..., 1] * (2 * half // step + 1) + at[..., 0], inside

    p, inside = flat(corner)
    return p, flat(middle)[0], inside


def _by_root(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of integers, sorted by their first column, in whole roots."""
    rest = None
    for batch in batches:
        rows = np.stack([surfaces._ints(c) for c in batch.columns], axis=1)
        rows = rows if rest is None else np.concatenate([rest, rows])
        if len(rows):
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last root may go on
            rest = rows[last:]
            if last:
                yield rows[:last]
    if rest is not None:
        yield rest


def build(samples: DataFrame, half: int, n: int, levels: int, tolerance: int, inner_tolerance: int, missing: int, roots: DataFrame | None) -> DataFrame:
    """``surfaces.build`` of roots that fit."""
    step = surfaces.reach(levels, half) // n
    width = 2 * half // step + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_root(batches):
            ids, owner = np.unique(rows[:, 0], return_inverse=True)
            values, held = np.full((len(ids), width * width), missing, np.int64), rows[:, 1] >= 0
            values[owner[held], rows[held, 1]] = rows[held, 2]
            for level in range(levels, -1, -1):
                p, q, inside = _places(level, half, n, step)
                count = len(p)
                matrix = np.zeros((len(ids) * count, 2 * n + 1, 2 * n + 1), np.int64)
                matrix[:, ::2, ::2], matrix[:, 1::2, 1::2] = values[:, p].reshape(-1, n + 1, n + 1), values[:, q].reshape(-1, n, n)
                at = np.tile(centres(level, half)[0], (len(ids), 1))
                out = surfaces._analysed(pa.array(np.repeat(ids, count)), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy()), level, matrix, tolerance if level == levels else inner_tolerance)
                values[:, p[inside]] = surfaces._matrix(out.column(4), (n + 1) ** 2).reshape(len(ids), count, -1)[:, inside]
                yield out

    rows = samples.where(F.col("px").between(0, 2 * half) & F.col("py").between(0, 2 * half) & (F.col("px") % step == 0) & (F.col("py") % step == 0) & F.col("value").isNotNull())
    rows = rows.where((F.col("px") / step + F.col("py") / step) % 2 == 0)
    rows = rows.select(F.col("root").cast("long").alias("root"), (F.col("py") / step * width + F.col("px") / step).cast("long").alias("place"), F.col("value").cast("long").alias("value"))
    roots = samples.select("root").distinct() if roots is None else roots
    every = roots.select(F.col("root").cast("long").alias("root"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("value"))  # also roots without samples inside
    return rows.unionByName(every).where("root is not null").repartition("root").sortWithinPartitions("root").mapInArrow(run, surfaces.BUILT)


def read(lows: np.ndarray, rooted: np.ndarray, records: list[tuple[np.ndarray, ...]], half: int, n: int) -> list[tuple[np.ndarray, ...]]:
    """(low, known, data level) of all diamonds of each level, (r, d, ...), as ``surfaces.synthesise``
    has them, from the roots' patches and records (codes, absent, present, tolerance) of
    each level but the last."""
    r, m = len(lows), (n + 1) ** 2
    low, known, data = lows.reshape(r, 1, m), np.repeat(rooted, 2).reshape(r, 1, 2), np.zeros((r, 1, 2), np.int64)
    out = [(low, known, data)]
    for level, (codes, absent, present, tolerance) in enumerate(records):
        d, index = centres(level, half)
        edge = ((d == 0) | (d == 2 * half)).any(axis=1)
        ready = np.where(edge, known.any(axis=2), known.all(axis=2)) & present
        i, j = np.nonzero(ready)
        details = np.clip(codes[i, j].reshape(-1, n, n) * (2 * tolerance[i, j] + 1)[:, None, None], surfaces._LEAST, surfaces._MOST)
        p = low[i, j].reshape(-1, n + 1, n + 1) - lifting.update(details)
        q = details + lifting.predict(p)
        ready[i, j] = ~surfaces._too_large(p, q)
        whole = np.zeros((len(i), 2 * n + 1, 2 * n + 1), np.int64)
        whole[:, ::2, ::2], whole[:, 1::2, 1::2] = p, q
        matrix = np.zeros((r, len(d), (2 * n + 1) ** 2), np.int64)
        matrix[i, j] = whole.reshape(len(i), (2 * n + 1) ** 2)
        below, s = centres(level + 1, half)[0], surfaces.reach(level, half)
        low2, held = np.zeros((r, len(below), m), np.int64), np.zeros((r, len(below), m), bool)
        known2, data2 = np.zeros((r, len(below), 2), bool), np.full((r, len(below), 2), -1, np.int64)
        for c, (cx, cy) in enumerate(below.tolist()):
            for dx, dy in surfaces.children(level, half):
                x, y = cx - dx, cy - dy
                k = int(index[x // s, y // s]) if 0 <= x <= 2 * half and 0 <= y <= 2 * half and x % s == 0 and y % s == 0 else -1
                if k < 0:
                    continue
                mine, theirs = surfaces.half_of(level, half, n, dx, dy)
                got, side = ready[:, k], 0 if (dy > 0 or (dy == 0 and dx > 0)) else 1  # the parent lies lower, or to the left
                rows = np.flatnonzero(got)
                low2[rows[:, None], c, mine], held[rows[:, None], c, mine] = matrix[rows[:, None], k, theirs], True
                first = surfaces._lower_side(level, *(np.array([v]) for v in (x, y, dx, dy)), half)[0]
                known2[:, c, side] = got
                data2[:, c, side] = np.where(absent[:, k], data[:, k, 0 if first else 1], level + 1)
        rising = np.tile(surfaces._rising(level + 1, below[:, 0], below[:, 1], half), r)
        low = surfaces.mirrored(low2.reshape(-1, n + 1, n + 1), held.reshape(-1, n + 1, n + 1), rising).reshape(r, len(below), m)
        known, data = known2, data2
        out.append((low, known, data))
    return out


def spacing(level: int, half: int, n: int, unit: float) -> float:
    s = surfaces.reach(level, half)
    return (2.0 * s if level % 2 else 2.0 * np.sqrt(2.0) * s) / n * unit


def _located(level: int, px: np.ndarray, py: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """``diamonds.locate`` of arrays of places."""
    s = surfaces.reach(level, half)
    cx, cy = ((np.maximum(0, np.minimum(np.floor(v / (2 * s)), half // s - 1)) * 2 + 1) * s for v in (px, py))
    if level % 2:
        dx, dy = px - cx, py - cy
        across = np.abs(dx) >= np.abs(dy)
        cx, cy = cx + np.where(across, np.where(dx < 0, -s, s), 0), cy + np.where(across, 0, np.where(dy < 0, -s, s))
    return cx.astype(np.int64), cy.astype(np.int64)


def heights(level: int, patches: tuple[np.ndarray, ...], r: np.ndarray, px: np.ndarray, py: np.ndarray, half: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, height, data level) of places in patches of a level, as ``surfaces.heights_at`` has them."""
    low, known, data = patches
    s, even = surfaces.reach(level, half), level % 2 == 0
    x, y = _located(level, px, py, half)
    d = centres(level, half)[1][x // s, y // s]
    dx, dy = (px - x) / s, (py - y) / s
    a, b = ((dx + 1) / 2 * n, (dy + 1) / 2 * n) if even else ((dx + dy + 1) / 2 * n, (dy - dx + 1) / 2 * n)
    a, b = np.minimum(np.maximum(a, 0.0), float(n)), np.minimum(np.maximum(b, 0.0), float(n))
    rising = surfaces._rising(level, x, y, half)
    far_a, far_b = ~rising & even, ~rising & (not even)
    along = np.where(far_a, n - a, a) + np.where(far_b, n - b, b)
    first = (along < n) | ((along == n) & known[r, d, 0])
    far_a, far_b = far_a == first, far_b == first
    u, v = np.where(far_a, n - a, a), np.where(far_b, n - b, b)
    p, q = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    over = p + q >= n
    p, q = np.where(over & (p > 0), p - 1, p), np.where(over & (p == 0), q - 1, q)
    du, dv = u - p, v - q

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = np.where(far_a, n - i, i), np.where(far_b, n - j, j)
        return low[r, d, np.clip(j * (n + 1) + i, 0, (n + 1) ** 2 - 1)]

    near = at(p, q) * (1 - du - dv) + at(p + 1, q) * du + at(p, q + 1) * dv
    beyond = at(p + 1, q + 1) * (du + dv - 1) + at(p + 1, q) * (1 - dv) + at(p, q + 1) * (1 - du)
    side = np.where(first, 0, 1)
    return known[r, d, side], np.where((du + dv <= 1) | (p + q + 1 == n), near, beyond), data[r, d, side]


def answer(requests: DataFrame, roots: DataFrame, records: DataFrame, half: int, n: int, levels: int, unit: float) -> DataFrame:
    """``surfaces.answer`` of roots that fit: a root's records come before its requests, so a
    task holds a batch and the records of one root.  Roots with over SHARE requests are dealt to several tasks."""
    gaps = np.array([spacing(k, half, n, unit) for k in range(levels + 1)])

    def answered(table: pa.Table) -> pa.RecordBatch:
        root, level = surfaces._ints(table["root"]), surfaces._ints(table["level"], -2)
        asks = table.filter(pa.array(level == -2))
        asked = surfaces._ints(asks["root"])
        ids, r = np.unique(asked, return_inverse=True)
        at = np.minimum(np.searchsorted(ids, root), len(ids) - 1)
        used = (level > -2) & (ids[at] == root)
        lows, rooted = np.zeros((len(ids), (n + 1) ** 2), np.int64), np.zeros(len(ids), bool)
        held, own = table.filter(pa.array(used & (level == -1))), at[used & (level == -1)]
        lows[own], rooted[own] = surfaces._matrix(held["numbers"].combine_chunks(), (n + 1) ** 2), True
        parts = []
        for k in range(levels):
            d, index = centres(k, half)
            s, mine = surfaces.reach(k, half), used & (level == k)
            held, own = table.filter(pa.array(mine)), at[mine]
            j = index[surfaces._ints(held["x"]) // s, surfaces._ints(held["y"]) // s]
            numbers = held["numbers"].combine_chunks()
            bare = numbers.is_null().to_numpy(zero_copy_only=False)
            shape = (len(ids), len(d))
            codes, absent, present, tolerance = np.zeros((*shape, n * n), np.int64), np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, np.int64)
            codes[own[~bare], j[~bare]] = surfaces._matrix(numbers, n * n)
            absent[own, j], present[own, j], tolerance[own, j] = bare, True, surfaces._ints(held["tolerance"])
            parts.append((codes, absent, present, tolerance))
        px, py, wanted = (asks[c].to_numpy() for c in ("px", "py", "wanted"))
        best, data, height = np.full(len(r), -1, np.int32), np.full(len(r), -1, np.int32), np.zeros(len(r))
        placed = np.isfinite(px) & np.isfinite(py) & asks["root"].is_valid().to_numpy()
        for k, patches in enumerate(read(lows, rooted, parts, half, n)):
            some = np.flatnonzero(placed if k == 0 else placed & (gaps[k - 1] > wanted))
            known, h, of = heights(k, patches, r[some], px[some], py[some], half, n)
            some = some[known]
            best[some], data[some], height[some] = k, of[known], h[known]
        none = best < 0
        reached = gaps[np.maximum(data, 0)]
        state = np.where(none, "unavailable", np.where(reached <= wanted, "ready", "limited"))
        columns = [asks["id"].combine_chunks(), *(pa.array(v, mask=none) for v in (best, data, height, reached)), pa.array(state)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "level", "data_level", "height", "spacing", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, AT_ONCE // sum(len(centres(k, half)[0]) for k in range(levels + 1)))
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest, batch])
            root = surfaces._ints(table["root"])
            begins = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1]))) if len(root) else np.empty(0, np.int64)
            is_ask = table["level"].is_null().to_numpy()
            for lo in range(0, len(begins), most):
                start, stop = int(begins[lo]), int(begins[lo + most]) if lo + most < len(begins) else len(root)
                if is_ask[start:stop].any():
                    yield answered(table.slice(start, stop - start))
            if len(root):
                rest = table.filter(pa.array(~is_ask & (root == root[-1]))).to_batches()  # requests for it may follow

    null = {"level": "int", "x": "long", "y": "long", "tolerance": "int", "numbers": "array<long>", "px": "double", "py": "double", "wanted": "double", "id": requests.schema["id"].dataType.simpleString()}

    def rows(df: DataFrame, **given) -> DataFrame:
        return df.select(F.col("root").cast("long").alias("root"), *((given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in null.items()))

    col = F.col
    requests = rows(requests, px=col("px"), py=col("py"), wanted=col("wanted"), id=col("id")).checkpoint()
    held = rows(roots, level=F.lit(-1), numbers=col("low")).unionByName(rows(records.where(col("level") < levels), level=col("level"), x=col("x"), y=col("y"), tolerance=col("tolerance"), numbers=col("codes")))
    held = held.where("root is not null")
    crowded = requests.groupBy("root").count().where(col("count") > SHARE).select(col("root").alias("of"), F.ceil(col("count") / SHARE).cast("int").alias("shares")).checkpoint()
    if crowded.head(1):
        shares = F.coalesce("shares", F.lit(1))
        requests = requests.join(F.broadcast(crowded), col("root").eqNullSafe(col("of")), "left").withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int")).drop("of", "shares")
        held = held.join(F.broadcast(crowded), col("root") == col("of"), "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("of", "shares")
    else:
        requests, held = (df.withColumn("share", F.lit(0)) for df in (requests, held))
    every = held.unionByName(requests).repartition("root", "share").sortWithinPartitions("root", "share", F.col("level").isNull())
    return every.drop("share").mapInArrow(run, f"id {null['id']}, level int, data_level int, height double, spacing double, state string")
