"""Height surfaces as hierarchies of diamonds: built from samples fine to coarse, and
given back coarse to fine.

A diamond's patch has (n + 1)^2 corners along its two edges from a first to a second
end.  Its record holds the n^2 details of the centres between them.  Corners and
centres together are the corners of its four children's halves on its own side, so a
level is built by bringing children to their parents, and read by bringing halves to
the children.  A child on the root's border has one half only; the other one mirrors it.

Rows of a patch are listed upwards and from left to right: by y and x on an even level,
from the lowest corner to the right and to the left one on an odd level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.bits import right
from tilewright.operators import diamonds, lifting, loops

KEY = ["root", "level", "x", "y"]
_LEAST, _MOST = -(1 << 31), (1 << 31) - 1


def reach(level: int, half: int) -> int:
    return half >> (level >> 1)


@cache
def corners(level: int, half: int, n: int) -> np.ndarray:
    """(n + 1, n + 1, 2): places of a patch's corners from its centre, in half steps of
    its finest part."""
    j, i = np.mgrid[: n + 1, : n + 1]
    s = reach(level, half)
    if level % 2:
        return np.stack([(i - j) * s // n, (i + j - n) * s // n], axis=-1)
    return np.stack([(2 * i - n) * s // n, (2 * j - n) * s // n], axis=-1)


@cache
def matrix_places(level: int, half: int, n: int) -> dict[tuple[int, int], int]:
    """Place from the centre -> index in the flat (2n + 1)^2 matrix of corners and centres."""
    grid = corners(level, half, n)
    out = {}
    for a in range(2 * n + 1):
        for b in range(2 * n + 1):
            if (a + b) % 2 == 0:
                x, y = grid[a // 2, b // 2]
                if a % 2:  # a centre: half a step on both axes from the corner before
                    x, y = (grid[a // 2, b // 2] + grid[a // 2 + 1, b // 2 + 1]) // 2
                out[int(x), int(y)] = a * (2 * n + 1) + b
    return out


@cache
def half_of(level: int, half: int, n: int, dx: int, dy: int) -> tuple[np.ndarray, np.ndarray]:
    """For the child at (dx, dy) from a diamond's centre: indices of the child's patch
    that lie in the diamond, and those of the diamond's matrix at the same places."""
    places = matrix_places(level, half, n)
    mine, theirs = [], []
    for k, (x, y) in enumerate(corners(level + 1, half, n).reshape(-1, 2)):
        at = places.get((int(x) + dx, int(y) + dy))
        if at is not None:
            mine.append(k)
            theirs.append(at)
    return np.array(mine), np.array(theirs)


def children(level: int, half: int) -> list[tuple[int, int]]:
    """Where a diamond's four children lie from its centre."""
    if level % 2:
        s = reach(level + 1, half)
        return [(-s, -s), (s, -s), (-s, s), (s, s)]
    s = reach(level, half)
    return [(0, -s), (-s, 0), (s, 0), (0, s)]


def mirrored(patches: np.ndarray, known: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Fills what isn't known of square patches (k, m, m) with the other side of the
    diagonal between the two sides: where ``rising``, the one that runs against the patch's main one."""
    main, against = patches.transpose(0, 2, 1), patches[:, ::-1, ::-1].transpose(0, 2, 1)
    return np.where(known, patches, np.where(rising[:, None, None], against, main))


def _split(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return matrix[:, ::2, ::2], matrix[:, 1::2, 1::2]


def _too_large(*parts: np.ndarray) -> np.ndarray:
    bad = np.zeros(len(parts[0]), bool)
    for p in parts:
        bad |= ((p < _LEAST) | (p > _MOST)).any(axis=(1, 2))
    return bad


def _ints(column: pa.Array, missing: int = 0) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows; null lists have none."""
    return _ints(column.flatten(), -1).reshape(-1, width)


def _lists(a: np.ndarray) -> pa.Array:
    width = int(np.prod(a.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * width), pa.array(a.ravel()))


def _same(value: int, rows: int) -> pa.Array:
    return pa.array(np.full(rows, value, np.int32))


def _offsets(dx: np.ndarray, dy: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(dx, dy, places) of each pair that occurs: four at most between diamonds and their children."""
    for x, y in np.unique(np.stack([dx, dy], axis=1), axis=0).tolist():
        yield x, y, np.flatnonzero((dx == x) & (dy == y))


BUILT = "root long, level int, x long, y long, low array<long>, codes array<long>, tolerance int, status string"


def _columns(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _analysed(root: pa.Array, x: pa.Array, y: pa.Array, level: int, matrix: np.ndarray, tolerance: int) -> pa.RecordBatch:
    """Records of matrices: details are quantised first, and corners gain from what the
    codes stand for, so that synthesis gives the corners back exactly."""
    p, q = _split(matrix)
    details = q - lifting.predict(p)
    codes = lifting.quantise(details, tolerance)
    low = p + lifting.update(lifting.dequantise(codes, tolerance))
    bad = _too_large(low, details)
    columns = [root, _same(level, len(bad)), x, y, _lists(low), _lists(codes), _same(tolerance, len(bad)), pa.array(np.where(bad, "overflow", "ok"))]
    return pa.RecordBatch.from_arrays(columns, names=_columns(BUILT))


MATRIX = "root long, x long, y long, matrix array<long>"


def sampled_leaves(samples: DataFrame, half: int, n: int, levels: int, missing: int = 0, roots: DataFrame | None = None) -> DataFrame:
    """(root, x, y, matrix): every leaf of the roots that have samples (root, px, py, value;
    ``roots`` has each root once, where that costs less than to look at all samples), with those in its matrix, flat, ``missing`` where there is none.  A sample goes to each
    of the one, two or four leaves that hold it.

    Rows are sorted by leaf and put into matrices as they come: a task holds no more than
    a batch and one leaf."""
    if levels % 2:
        raise ValueError("leaves are cells of an even level")
    s, step = reach(levels, half), reach(levels, half) // n
    if step * n != s:
        raise ValueError(f"a leaf of half width {s} can't hold {n} samples")

    def cells(v: str) -> Column:
        last = half // s - 1
        k = F.floor(F.col(v) / (2 * s)).cast("long")
        shared = (F.col(v) % (2 * s) == 0) & k.between(1, last)
        return F.explode(F.when(shared, F.array(k, k - 1)).otherwise(F.array(F.least(k, F.lit(last)))))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = np.stack([_ints(c) for c in batch.columns], axis=1)
            rows = rows if rest is None else np.concatenate([rest, rows])
            if len(rows):
                last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))[-1]) + 1 if (rows[0, :3] != rows[-1, :3]).any() else 0
                rest = rows[last:]  # the last leaf may go on
                if last:
                    yield matrices(rows[:last])
        if rest is not None:
            yield matrices(rest)

    def matrices(rows: np.ndarray) -> pa.RecordBatch:
        fresh = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        leaf, m = np.cumsum(fresh) - 1, np.full((int(fresh.sum()), (2 * n + 1) ** 2), missing, np.int64)
        held = rows[:, 3] >= 0
        m[leaf[held], rows[held, 3]] = rows[held, 4]
        return pa.RecordBatch.from_arrays([*(pa.array(rows[fresh, k]) for k in range(3)), _lists(m)], names=_columns(MATRIX))

    keys = ["root", "x", "y"]
    rows = samples.where(F.col("px").between(0, 2 * half) & F.col("py").between(0, 2 * half) & (F.col("px") % step == 0) & (F.col("py") % step == 0) & F.col("value").isNotNull())
    rows = rows.where((F.col("px") / step + F.col("py") / step) % 2 == 0)  # corners and centres of any leaf
    rows = rows.withColumn("cx", cells("px")).withColumn("cy", cells("py")).select("root", "value", "px", "py", ((F.col("cx") * 2 + 1) * s).alias("x"), ((F.col("cy") * 2 + 1) * s).alias("y"))
    a, b = (((F.col(p) - F.col(c) + s) / step).cast("int") for p, c in (("py", "y"), ("px", "x")))
    rows = rows.select(*keys, (a * (2 * n + 1) + b).cast("long").alias("place"), F.col("value").cast("long").alias("value"))
    roots = samples.select("root").distinct() if roots is None else roots
    every = diamonds.complete(roots.where("root is not null"), half, levels).where(F.col("level") == levels)
    every = every.select(*keys, F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("value"))  # a row for each leaf, also without samples
    return rows.where("root is not null").unionByName(every).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(filled, MATRIX)


def build(samples: DataFrame, half: int, n: int, levels: int, tolerance: int = 0, inner_tolerance: int = 0, missing: int = 0, roots: DataFrame | None = None) -> DataFrame:
    """Records (root, level, x, y, low, codes, tolerance, status) of every diamond of
    the roots that have samples (root, px, py, value; one for a place).

    Leaves are cells of level ``levels``, sampled from the input, ``missing`` where it
    has none; all others are made of their children's low parts.  Details are quantised
    by ``tolerance`` at leaves and by ``inner_tolerance`` above: with 0 there, leaves come
    back within ``tolerance``.  ``low`` is what a diamond gives to its parents; at level 0
    it is the root's patch.  A diamond that leaves 32 bits has the status overflow."""
    from tilewright.operators import whole_roots

    loops.ensure_checkpoint_dir(samples.sparkSession)
    if levels % 2 == 0 and reach(levels, half) % n == 0 and whole_roots.fits(half, levels):
        return whole_roots.build(samples, half, n, levels, tolerance, inner_tolerance, missing, roots).checkpoint()
    size = (2 * n + 1) ** 2

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, x, y, matrix = batch.columns
            yield _analysed(root, x, y, levels, _matrix(matrix, size).reshape(-1, 2 * n + 1, 2 * n + 1), tolerance)

    def inner(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                root, x, y, part_x, part_y, low = batch.columns
                m, known = np.zeros((batch.num_rows, size), np.int64), np.zeros((batch.num_rows, size), bool)
                own_x, own_y, low = _ints(x), _ints(y), _matrix(low, (n + 1) ** 2)
                owner = np.repeat(np.arange(batch.num_rows), _ints(part_x.value_lengths()))
                for dx, dy, at in _offsets(_ints(part_x.flatten()) - own_x[owner], _ints(part_y.flatten()) - own_y[owner]):
                    mine, theirs = half_of(level, half, n, dx, dy)
                    place = owner[at][:, None], theirs[None, :]
                    m[place], known[place] = low[at][:, mine], True
                shape = (batch.num_rows, 2 * n + 1, 2 * n + 1)
                side = (own_x == 0) | (own_x == 2 * half)
                yield _analysed(root, x, y, level, mirrored(m.reshape(shape), known.reshape(shape), ~side), inner_tolerance)

        return run

    now = sampled_leaves(samples, half, n, levels, missing, roots).mapInArrow(leaves, BUILT).checkpoint()  # each level reads the one below
    out = now
    for level in range(levels - 1, -1, -1):
        up = diamonds.with_parents(now, half, ["root", "low"])
        parts = up.groupBy("root", F.col("parent_x").alias("px"), F.col("parent_y").alias("py")).agg(F.collect_list(F.struct("x", "y", "low")).alias("parts"))  # four at most
        flat = parts.select("root", F.col("px").alias("x"), F.col("py").alias("y"), F.col("parts.x").alias("part_x"), F.col("parts.y").alias("part_y"), F.flatten("parts.low").alias("low"))
        now = flat.mapInArrow(inner(level), BUILT).checkpoint()
        out = out.unionByName(now)
    return out


PATCH = "root long, level int, x long, y long, low array<long>, known array<boolean>, data_levels array<int>"
HALVES = "root long, x long, y long, from_x long, from_y long, part array<long>, data_level int"
LEAF = "root long, x long, y long, corners array<long>, centres array<long>, status string"


def synthesise(roots: DataFrame, records: DataFrame, half: int, n: int, levels: int, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(patches, leaves) from roots (root, low) and records (root, level, x, y, codes, tolerance).

    A diamond is refined if all of its sides that lie in the root are known and there is
    a record of it; null codes stand for a place that has no details, whose children are
    smooth and keep the level of their data.  Without a record, or where a value leaves
    32 bits, all below stays unknown.

    patches (root, level, x, y, low, known, data_levels): each diamond of which a side is
    known; ``known`` and ``data_levels`` are of its lower (or, of two at the same height,
    left) and its other side.  leaves: (root, x, y, corners, centres, status) of the
    refined diamonds of the last level, overflow if a value leaves 32 bits.  With
    ``wanted`` (root, level, x, y) only those diamonds are refined."""
    loops.ensure_checkpoint_dir(records.sparkSession)

    def refined(level: int, whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                root, x, y, low, data_levels, coded, tolerance = batch.columns
                low = _matrix(low, (n + 1) ** 2).reshape(-1, n + 1, n + 1)
                absent = coded.is_null().to_numpy(zero_copy_only=False)
                codes = np.zeros((batch.num_rows, n, n), np.int64)
                codes[~absent] = _matrix(coded, n * n).reshape(-1, n, n)
                step = 2 * _ints(tolerance)[:, None, None] + 1
                details = np.clip(codes * step, _LEAST, _MOST)
                p = low - lifting.update(details)
                q = details + lifting.predict(p)
                bad = _too_large(p, q)
                if whole:
                    yield pa.RecordBatch.from_arrays([root, x, y, _lists(p), _lists(q), pa.array(np.where(bad, "overflow", "ok"))], names=_columns(LEAF))
                    continue
                m = np.zeros((batch.num_rows, 2 * n + 1, 2 * n + 1), np.int64)
                m[:, ::2, ::2], m[:, 1::2, 1::2] = p, q
                m = m.reshape(-1, (2 * n + 1) ** 2)
                x, y, own = _ints(x), _ints(y), _matrix(data_levels, 2)
                for dx, dy in children(level, half):
                    kept = ~bad & (x + dx >= 0) & (x + dx <= 2 * half) & (y + dy >= 0) & (y + dy <= 2 * half)
                    good_x, good_y = x[kept], y[kept]
                    mine, at = half_of(level, half, n, dx, dy)
                    part = np.zeros((len(good_x), (n + 1) ** 2), np.int64)
                    part[:, mine] = m[kept][:, at]
                    # the side of the diamond on which the child stands
                    first = _lower_side(level, good_x, good_y, np.full(len(good_x), dx), np.full(len(good_x), dy), half)
                    data = np.where(absent[kept], np.where(first, own[kept, 0], own[kept, 1]), level + 1)
                    columns = [root.filter(pa.array(kept)), *(pa.array(v) for v in (good_x + dx, good_y + dy, good_x, good_y)), _lists(part), pa.array(data.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=_columns(HALVES))

        return run

    def assembled(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                root, x, y, from_x, from_y, parts, levels_of = batch.columns
                rows = batch.num_rows
                low, known = np.zeros((rows, (n + 1) ** 2), np.int64), np.zeros((rows, (n + 1) ** 2), bool)
                sides, data = np.zeros((rows, 2), bool), np.full((rows, 2), -1, np.int32)
                own_x, own_y, parts, levels_of = _ints(x), _ints(y), _matrix(parts, (n + 1) ** 2), _ints(levels_of.flatten(), -1)
                owner = np.repeat(np.arange(rows), _ints(from_x.value_lengths()))
                for dx, dy, at in _offsets(own_x[owner] - _ints(from_x.flatten()), own_y[owner] - _ints(from_y.flatten())):
                    mine, _ = half_of(level - 1, half, n, dx, dy)
                    place = owner[at][:, None], mine[None, :]
                    low[place], known[place] = parts[at][:, mine], True
                    side = 0 if (dy > 0 or (dy == 0 and dx > 0)) else 1  # the parent lies lower, or to the left
                    sides[owner[at], side], data[owner[at], side] = True, levels_of[at]
                rising = _rising(level, own_x, own_y, half)
                low = mirrored(low.reshape(-1, n + 1, n + 1), known.reshape(-1, n + 1, n + 1), rising)
                known_levels = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * 2), pa.array(data.ravel(), mask=data.ravel() < 0))
                yield pa.RecordBatch.from_arrays([root, _same(level, rows), x, y, _lists(low), _lists(sides), known_levels], names=_columns(PATCH))

        return run

    keys = ["root", "x", "y"]
    now = roots.select(F.col("root").cast("long").alias("root"), F.lit(0).alias("level"), F.lit(half).cast("long").alias("x"), F.lit(half).cast("long").alias("y"), F.col("low").cast("array<long>").alias("low"), F.array(F.lit(True), F.lit(True)).alias("known"), F.array(F.lit(0), F.lit(0)).alias("data_levels"))
    out = now
    for level in range(levels + 1):
        of_level = records.where(F.col("level") == level).select(*keys, "codes", "tolerance")
        edge = F.col("x").isin(0, 2 * half) | F.col("y").isin(0, 2 * half)
        ready = now.where(F.when(edge, F.col("known")[0] | F.col("known")[1]).otherwise(F.col("known")[0] & F.col("known")[1]))
        if wanted is not None:
            ready = ready.join(wanted.where(F.col("level") == level).select(*keys), keys, "left_semi")
        ready = ready.select(*keys, "low", "data_levels").join(of_level, keys)
        if level == levels:
            return out, ready.mapInArrow(refined(level, True), LEAF)
        parts = ready.mapInArrow(refined(level, False), HALVES)
        parts = parts.groupBy(*keys).agg(F.collect_list(F.struct("from_x", "from_y", "part", "data_level")).alias("parts"))  # two at most
        flat = parts.select(*keys, F.col("parts.from_x").alias("from_x"), F.col("parts.from_y").alias("from_y"), F.flatten("parts.part").alias("part"), F.col("parts.data_level").alias("data_level"))
        now = flat.mapInArrow(assembled(level + 1), PATCH).checkpoint()  # each level reads the one above
        out = out.unionByName(now)
    raise AssertionError("unreachable")


def _rising(level: int, x: np.ndarray, y: np.ndarray, half: int) -> np.ndarray:
    """Whether a patch's two sides lie about its first and last corner: the sides' border
    runs against the main diagonal."""
    s = reach(level, half)
    if level == 0:
        return np.ones(len(x), bool)
    if level % 2:
        return (x // s) % 2 == 1  # parents below and above
    return ((x - s) // reach(level - 1, half) + (y - s) // reach(level - 1, half)) % 2 == 1


def _lower_side(level: int, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, half: int) -> np.ndarray:
    """Whether what lies at (dx, dy) from a diamond's centre is on the side of its lower (or left) parent."""
    rising = _rising(level, x, y, half)
    if level % 2:
        return np.where(rising, dy < 0, dx < 0)
    return np.where(rising, dx + dy < 0, dy - dx < 0)


def spacing(level: Column, half: int, n: int, unit: float = 1.0) -> Column:
    """Longest edge of a side of a diamond over the samples along it."""
    s = right(F.lit(half), right(level, 1))
    return F.when(level % 2 == 1, 2.0 * s).otherwise(2.0 * F.sqrt(F.lit(2.0)) * s) / n * unit


def heights_at(points: DataFrame, patches: DataFrame, half: int, n: int, keep: list[str]) -> DataFrame:
    """Points (root, level, x, y, px, py and the columns to keep) with ``height``, that of
    the side of their diamond that they lie in, and ``data_level``: linear in triangles
    that split a side's cells along the border between both sides, which itself belongs
    to the first that is known.  Points whose side isn't known have no row."""
    level, s = F.col("level"), right(F.lit(half), right(F.col("level"), 1))
    dx, dy = (F.col("px") - F.col("x")) / s, (F.col("py") - F.col("y")) / s
    # places along the patch's two axes, from 0 to n
    a = F.when(level % 2 == 1, (dx + dy + 1) / 2).otherwise((dx + 1) / 2) * n
    b = F.when(level % 2 == 1, (dy - dx + 1) / 2).otherwise((dy + 1) / 2) * n
    up = right(F.lit(half), right(level - 1, 1))
    rising = F.when(level == 0, True).when(level % 2 == 1, F.pmod(F.col("x") / s, F.lit(2)) == 1).otherwise(F.pmod((F.col("x") - s) / up + (F.col("y") - s) / up, F.lit(2)) == 1)
    rows = points.join(patches, KEY).select(*keep, "level", "low", "known", "data_levels", F.least(F.greatest(a, F.lit(0.0)), F.lit(float(n))).alias("a"), F.least(F.greatest(b, F.lit(0.0)), F.lit(float(n))).alias("b"), rising.alias("rising"))
    # whether the first side's own corner lies at the far end of each axis; that of the second lies opposite
    far_a, far_b = ~F.col("rising") & (level % 2 == 0), ~F.col("rising") & (level % 2 == 1)
    along = F.when(far_a, n - F.col("a")).otherwise(F.col("a")) + F.when(far_b, n - F.col("b")).otherwise(F.col("b"))
    first = (along < n) | ((along == n) & F.col("known")[0])
    rows = rows.withColumn("first", first).withColumn("far_a", far_a == first).withColumn("far_b", far_b == first)
    rows = rows.where(F.when(F.col("first"), F.col("known")[0]).otherwise(F.col("known")[1]))
    u, v = (F.when(F.col(f), n - F.col(c)).otherwise(F.col(c)) for f, c in (("far_a", "a"), ("far_b", "b")))
    rows = rows.withColumn("u", u).withColumn("v", v).withColumn("p", F.floor("u").cast("int")).withColumn("q", F.floor("v").cast("int"))
    over = F.col("p") + F.col("q") >= n
    rows = rows.withColumn("cell", F.struct(F.when(over & (F.col("p") > 0), F.col("p") - 1).otherwise(F.col("p")).alias("p"), F.when(over & (F.col("p") == 0), F.col("q") - 1).otherwise(F.col("q")).alias("q")))
    p, q = F.col("cell.p"), F.col("cell.q")
    du, dv = F.col("u") - p, F.col("v") - q

    def at(i: Column, j: Column) -> Column:
        i, j = F.when(F.col("far_a"), n - i).otherwise(i), F.when(F.col("far_b"), n - j).otherwise(j)
        return F.get("low", j * (n + 1) + i)

    near = at(p, q) * (1 - du - dv) + at(p + 1, q) * du + at(p, q + 1) * dv
    beyond = at(p + 1, q + 1) * (du + dv - 1) + at(p + 1, q) * (1 - dv) + at(p, q + 1) * (1 - du)
    height = F.when((du + dv <= 1) | (p + q + 1 == n), near).otherwise(beyond)
    return rows.select(*keep, "level", height.alias("height"), F.when(F.col("first"), F.col("data_levels")[0]).otherwise(F.col("data_levels")[1]).alias("data_level"))


def answer(requests: DataFrame, roots: DataFrame, records: DataFrame, half: int, n: int, levels: int, unit: float = 1.0) -> DataFrame:
    """Requests (id, root, px, py, wanted) with level, data_level, height, spacing, state.

    A request wants the coarsest level whose spacing is ``wanted`` at most, or else the
    last one.  All that this depends on, at both sides of each diamond, is fetched once
    and read down; the answer is of the finest level that could be read.  ready: its
    data are as fine as wanted; limited: coarser; unavailable: there is no root."""
    from tilewright.operators import whole_roots

    loops.ensure_checkpoint_dir(requests.sparkSession)
    if whole_roots.fits(half, levels):
        return whole_roots.answer(requests, roots, records, half, n, levels, unit)
    level = F.col("level")
    every = requests.where("px is not null and py is not null").select("id", "root", "px", "py", "wanted", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    finer = spacing(level - 1, half, n, unit)  # a level is asked for if the one above is too coarse
    every = every.where((level == 0) | (finer > F.col("wanted")))
    x, y = diamonds.locate(level, F.col("px"), F.col("py"), half)
    every = every.withColumn("x", x).withColumn("y", y)
    wanted = diamonds.needed(every.select(*KEY).distinct(), half, levels, ["root"])
    patches, _ = synthesise(roots, records, half, n, levels, wanted)
    rows = heights_at(every, patches, half, n, ["id", "root", "wanted"])
    best = rows.groupBy("id").agg(F.max_by(F.struct("level", "data_level", "height"), "level").alias("best")).select("id", "best.*")
    reached = spacing(F.col("data_level"), half, n, unit)
    state = F.when(F.col("level").isNull(), "unavailable").when(reached <= F.col("wanted"), "ready").otherwise("limited")
    return requests.select("id", "wanted").join(best, "id", "left").select("id", "level", "data_level", "height", reached.alias("spacing"), state.alias("state"))
