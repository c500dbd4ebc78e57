"""Cuts of the globe's diamonds by their projected size, for many cameras at once.

A diamond is refined if its oriented box looks larger than a threshold, and so is every
diamond that this depends on: all its parents within the globe, which may lie on the far
side of the neighbour.  Both ways, down by size and up by dependence, are taken by one
frontier of newly refined diamonds until there are none, for a batch of cameras at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo, grid
from tilewright.operators import loops

KEY = ["camera", "level", "i", "j", "k"]
#: Priority of a box that holds the eye.
INSIDE = float(1 << 30)
#: Cameras whose graphs a task holds at once, diamonds that it measures or returns at once,
#: and different ones that it keeps for the next cameras.
CAMERAS, MEASURED, KNOWN = 512, 16_384, 100_000


def degrees(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longitude, latitude) of points (..., 3) of the unrolled cylinder."""
    q, h = grid.HALF // 2, float(grid.HALF)
    i, k = points[..., 0], points[..., 2]
    along = np.select([k == q, i == q, k == -q, i == -q], [i + q - 2 * h, q - k - h, q - i, k + q + h], 0.0)
    return along * (90 / h), points[..., 1] * (90 / h)


def unit(points: np.ndarray) -> np.ndarray:
    a, b = (np.radians(v) for v in degrees(points))
    return np.stack([np.sin(a) * np.cos(b), np.sin(b), np.cos(a) * np.cos(b)], axis=-1)


def _normal(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.where(length == 0, 1, length)


def boxes(corners: np.ndarray, low: float, high: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres (n, 3), axes (n, 3, 3), half sides (n, 3)) of boxes round the patches of
    diamonds (n, 4, 3) between two heights.  The third axis points up at the centre, the
    first along an edge; of a corner beyond a pole the opposite one stands for it."""
    centre = (corners[:, 0] + corners[:, 2]) // 2
    first, second = (np.where(inside(corners[:, c])[:, None], corners[:, c], corners[:, 4 - c]) for c in (1, 3))
    points = unit(np.stack([centre, corners[:, 0], first, corners[:, 2], second], axis=1))
    z = points[:, 0]
    edge = _normal((points[:, 2] - points[:, 1]) * radius)
    x = _normal(edge - z * (z * edge).sum(axis=1, keepdims=True))
    axes = np.stack([x, -np.cross(x, z), z], axis=1)
    local = np.einsum("npd,nad->npa", points, axes)
    spans = np.concatenate([local * (radius + low), local * (radius + high)], axis=1)
    least, most = spans.min(axis=1), spans.max(axis=1)
    return np.einsum("na,nad->nd", (least + most) / 2, axes), axes, (most - least) / 2


def inside(points: np.ndarray) -> np.ndarray:
    """Whether points lie between the poles."""
    return (np.abs(points) <= grid.HALF).all(axis=-1)


def visible(centre: np.ndarray, axes: np.ndarray, half: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Whether boxes reach the inner side of each of their planes (n, p, 4)."""
    normals = planes[..., :3]
    far = np.einsum("npd,nd->np", normals, centre) + planes[..., 3] + np.einsum("npa,na->np", np.abs(np.einsum("npd,nad->npa", normals, axes)), half)
    return (far > 0).all(axis=1)


def distances(centre: np.ndarray, axes: np.ndarray, half: np.ndarray, points: np.ndarray) -> np.ndarray:
    """From points (n, 3) to boxes; 0 inside."""
    local = np.einsum("nad,nd->na", axes, points - centre)
    beyond = np.maximum(np.abs(local) - half, 0)
    return np.sqrt((beyond**2).sum(axis=1))


def areas(axes: np.ndarray, half: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Of boxes projected along directions (n, 3)."""
    sides = 4 * np.stack([half[:, 1] * half[:, 2], half[:, 2] * half[:, 0], half[:, 0] * half[:, 1]], axis=1)
    return (np.abs(np.einsum("nad,nd->na", axes, directions)) * sides).sum(axis=1)


def _wrapped(p: np.ndarray) -> np.ndarray:
    """Points that left a face, folded round the edge onto the next one."""
    q, out = grid.HALF // 2, p.copy()
    done = np.zeros(len(p), bool)
    for a, b in ((0, 2), (2, 0)):
        over = np.maximum(np.abs(p[:, a]) - q, 0) * ~done
        out[:, a] = np.where(over > 0, np.sign(p[:, a]) * q, out[:, a])
        out[:, b] = np.where(over > 0, p[:, b] - np.where(np.abs(p[:, b]) == q, np.sign(p[:, b]) * over, 0), out[:, b])
        done |= over > 0
    return out


def child(corners: np.ndarray, side: int, which: int) -> np.ndarray:
    """Children (n, 4, 3) of diamonds on a side: the parent and its centre are neighbours
    of the corner that they share, the last corner lies opposite the centre."""
    centre = (corners[:, 0] + corners[:, 2]) // 2
    first, second = corners[:, (2 * side + which) % 4], corners[:, (2 * side + which + 1) % 4]
    own, near = (second, first) if which == 0 else (first, second)
    far = 2 * ((first + second) // 2) - centre
    ring = (own, centre, near, far) if which == 0 else (own, far, near, centre)
    return np.stack([ring[0], _wrapped(ring[1]), ring[2], _wrapped(ring[3])], axis=1)


class _Diamonds:
    """The diamonds that the cameras of a task have made, each once: places, corners, boxes,
    and by number their parents, and the children of those that any camera has refined."""

    def __init__(self, low: float, high: float, radius: float) -> None:
        self.range, self.at = (low, high, radius), {}
        self.level, self.place, self.corners = np.empty(0, np.int64), np.empty((0, 3), np.int64), np.empty((0, 4, 3), np.int64)
        self.kids, self.up = np.empty((0, 4), np.int64), np.empty((0, 2), np.int64)  # -1: not on the globe, -2: not known yet
        self.box = (np.empty((0, 3)), np.empty((0, 3, 3)), np.empty((0, 3)))

    def numbers(self, level: int, corners: np.ndarray) -> np.ndarray:
        """Of diamonds (n, 4, 3) of a level; makes those that are new."""
        place = (corners[:, 0] + corners[:, 2]) // 2
        out, new = np.empty(len(corners), np.int64), []
        for n, key in enumerate(map(tuple, place.tolist())):
            if (level, key) not in self.at:
                self.at[level, key] = len(self.at)
                new.append(n)
            out[n] = self.at[level, key]
        if new:
            self.level = np.concatenate([self.level, np.full(len(new), level)])
            self.place, self.corners = np.concatenate([self.place, place[new]]), np.concatenate([self.corners, corners[new]])
            self.kids, self.up = np.concatenate([self.kids, np.full((len(new), 4), -2)]), np.concatenate([self.up, np.full((len(new), 2), -2)])
            self.box = tuple(np.concatenate(v) for v in zip(self.box, boxes(corners[new], *self.range), strict=True))
        return out

    def children(self, ids: np.ndarray) -> np.ndarray:
        """(n, 4) numbers on the sides whose parent lies on the globe, -1 on the others."""
        new = np.unique(ids[self.kids[ids, 0] == -2])
        for level in np.unique(self.level[new]).tolist():
            some = new[self.level[new] == level]
            for side in (0, 1):
                fine = inside(self.corners[some, 1 + 2 * side])
                for which in (0, 1):
                    self.kids[some, 2 * side + which] = -1
                    self.kids[some[fine], 2 * side + which] = self.numbers(level + 1, child(self.corners[some[fine]], side, which))
        return self.kids[ids]

    def parents(self, ids: np.ndarray) -> np.ndarray:
        """(n, 2) numbers, -1 outside the globe, -2 where not made yet."""
        for side in (0, 1):
            for n in np.unique(ids[self.up[ids, side] == -2]).tolist():
                p = self.corners[n, 1 + 2 * side]
                there = self.level[n] > 0 and inside(p)
                self.up[n, side] = self.at.get((int(self.level[n]) - 1, tuple(p.tolist())), -2) if there else -1
        return self.up[ids]


_ROOTS = np.array([[grid.CYLINDER_POINTS[c] for c in r] for r in grid.CYLINDER_ROOTS])


def _cut_batch(known: _Diamonds, eyes: np.ndarray, planes: np.ndarray, threshold: float, samples: int, levels: int) -> tuple[np.ndarray, ...]:
    """(camera's place, diamond, visible, priority, refined, sides) of all diamonds of some cameras' graphs."""
    count = len(eyes)

    def measured(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, who = np.divmod(keys, count)
        centre, axes, half = (v[ids] for v in known.box)
        seen, away = visible(centre, axes, half, planes[who]), distances(centre, axes, half, eyes[who])
        with np.errstate(divide="ignore"):
            size = np.where(away == 0, INSIDE, np.sqrt(areas(axes, half, _normal(centre - eyes[who]))) / (samples * away))
        return seen, np.where(seen, size, 0.0)

    def add(keys: np.ndarray) -> np.ndarray:
        """Makes diamonds; those that are large."""
        cuts = range(0, len(keys), MEASURED)
        parts = [measured(keys[n : n + MEASURED]) for n in cuts] or [(np.empty(0, bool), np.empty(0))]
        seen, size = (np.concatenate(v) for v in zip(*parts, strict=True))
        made.append((keys, seen, size))
        return keys[(size > threshold) & (known.level[keys // count] < levels)]

    # a diamond of a camera is one number: of the diamond, then of the camera
    made: list[tuple[np.ndarray, ...]] = []
    refined = fresh = add((known.numbers(0, _ROOTS)[:, None] * count + np.arange(count)).ravel())
    all_made, waiting = made[0][0], np.empty((0, 2), np.int64)  # waiting: (refined diamond, its side) whose parent isn't made
    for _ in range(4 * levels + 4):  # a way of dependence goes down and up each level
        if not len(fresh):
            break
        ids, who = np.divmod(fresh, count)
        kids = known.children(ids)
        kids = np.unique((kids * count + who[:, None])[kids >= 0])
        kids = kids[~np.isin(kids, all_made)]
        all_made = np.concatenate([all_made, kids])
        grown = add(kids)
        refined = np.concatenate([refined, grown])
        asks = np.concatenate([waiting, np.stack([np.repeat(fresh, 2), np.tile([0, 1], len(fresh))], axis=1)])
        up = known.parents(asks[:, 0] // count)[np.arange(len(asks)), asks[:, 1]]
        asks, up = asks[up != -1], up[up != -1]
        keys = np.where(up >= 0, up * count + asks[:, 0] % count, -1)
        there = np.isin(keys, all_made)
        waiting = asks[~there]  # their parents come first
        forced = np.setdiff1d(keys[there], refined)
        fresh, refined = np.concatenate([grown, forced]), np.concatenate([refined, forced])
    else:
        raise RuntimeError("no end of dependences")
    if len(waiting):
        raise RuntimeError("a diamond depends on one that isn't there")
    keys, seen, size = (np.concatenate(v) for v in zip(*made, strict=True))
    ids, who = np.divmod(keys, count)
    up = known.parents(ids)
    sides = np.isin(np.where(up >= 0, up * count + who[:, None], -1), refined) @ np.array([1, 2])
    return who, ids, seen, size, np.isin(keys, refined), np.where(known.level[ids] == 0, 3, sides)


def marked(cameras: DataFrame, threshold: float, samples: int, levels: int, low: float = 0.0, high: float = 0.0, radius: float = geo.RADIUS, corners: bool = False) -> DataFrame:
    """(camera, level, i, j, k, visible, priority, refined, sides), and d if ``corners``: all
    diamonds of the graphs of cameras (camera, eye, planes), as ``cut`` has them, whether
    they are refined, and the sides (bit 0 and 1) whose parent is.

    Cameras don't depend on one another: they are dealt out and each task takes CAMERAS of
    them at a time, so its memory is bounded by their graphs, and nothing else is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Diamonds(low, high, radius)
        for whole in batches:
            for first in range(0, whole.num_rows, CAMERAS):
                batch = whole.slice(first, CAMERAS)
                if len(known.at) > KNOWN:
                    known = _Diamonds(low, high, radius)
                eyes, planes = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, *shape) for c, shape in ((1, (3,)), (2, (-1, 4))))
                who, ids, seen, size, refined, sides = _cut_batch(known, eyes, planes, threshold, samples, levels)
                for n in range(0, len(who), MEASURED):
                    at, part = ids[n : n + MEASURED], slice(n, n + MEASURED)
                    columns = [batch.column(0).take(pa.array(who[part])), pa.array(known.level[at].astype(np.int32)), *(pa.array(known.place[at, a]) for a in range(3))]
                    columns += [pa.array(seen[part]), pa.array(size[part]), pa.array(refined[part]), pa.array(sides[part].astype(np.int32))]
                    if corners:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 12), pa.array(known.corners[at].ravel())))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = f"{', '.join(f'{c} {t}' for c, t in zip(KEY, ('long', 'int', 'long', 'long', 'long'), strict=True))}, visible boolean, priority double, refined boolean, sides int" + (", d array<long>" if corners else "")
    names = [f.split()[0] for f in fields.split(", ")]
    spark = cameras.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cameras.select(F.col("camera").cast("long").alias("camera"), "eye", "planes").where("camera is not null")
    return rows.repartition(tasks, "camera").mapInArrow(run, fields)


def cut(cameras: DataFrame, threshold: float, samples: int, levels: int, low: float = 0.0, high: float = 0.0, radius: float = geo.RADIUS) -> tuple[DataFrame, DataFrame]:
    """(nodes, refined) of the globe for cameras (camera, eye, planes: doubles of
    a x + b y + c z + d, positive inside).

    nodes (camera, level, i, j, k, d, visible, priority): all diamonds of the graph, d
    their four corners; priority is the root of the projected area over ``samples`` times
    the distance, 0 if not visible.  refined: those that have children; the others are
    the cut.  No diamond below ``levels`` is made.  Each diamond that is refined has all
    its parents refined."""
    loops.ensure_checkpoint_dir(cameras.sparkSession)
    every = marked(cameras, threshold, samples, levels, low, high, radius, corners=True).checkpoint()
    return every.select(*KEY, "d", "visible", "priority"), every.where("refined").select(*KEY, "d")


def leaves(nodes: DataFrame, refined: DataFrame) -> DataFrame:
    """The cut: nodes that aren't refined, with the sides (bit 0 and 1) whose parent is."""
    out = nodes.join(refined.select(*KEY), KEY, "left_anti")
    for f in (0, 1):
        p = {a: F.col("d")[3 + 6 * f + n] for n, a in enumerate(grid.AXES)}
        up = refined.select("camera", (F.col("level") + 1).alias("level"), *(F.col(a).alias(f"p_{a}") for a in grid.AXES), F.lit(1).alias(f"side{f}"))
        out = out.withColumns({f"p_{a}": p[a] for a in grid.AXES}).join(up, ["camera", "level", *(f"p_{a}" for a in grid.AXES)], "left").drop(*(f"p_{a}" for a in grid.AXES))
    side = [F.when(F.col("level") == 0, 1).otherwise(F.coalesce(f"side{f}", F.lit(0))) for f in (0, 1)]
    return out.select(*KEY, (side[0] + 2 * side[1]).alias("sides"), "visible", "priority")
