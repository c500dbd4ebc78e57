"""Triangles under a camera: culled, clipped, projected, and how finely they show a texture.

Kernels work on batches of triangles at once: a polygon is a row of nine points at most,
as each of six planes adds one to a triangle's three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.bits import right

#: Share of its terms by which an orientation must differ from zero to count.
MARGIN = 1e-6
#: Of a clipped triangle.
MOST_POINTS = 9


def to_clip(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Homogeneous coordinates (n, 3, 4) of triangles (n, 3, 3)."""
    return points @ matrix[:, :3].T + matrix[:, 3]


def faces_away(clip: np.ndarray) -> np.ndarray:
    """Whether triangles show their back for certain: the sign of the volume that they
    span with the eye, which clipping doesn't change."""
    flat = clip[..., [0, 1, 3]]
    a, b, c = flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2] - flat[:, 0]
    terms = a * np.cross(b, c)
    scale = np.abs(flat).max(axis=1).prod(axis=1)
    return terms.sum(axis=1) > MARGIN * (np.abs(terms).sum(axis=1) + scale)


def clipped(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(polygons (n, 9, m), counts) of triangles (n, 3, m) within -w <= x, y, z <= w; the
    first four of m values are x, y, z and w, the others go along."""
    n, _, m = points.shape
    now = np.zeros((n, MOST_POINTS, m))
    now[:, :3] = points
    count = np.full(n, 3)
    place = np.arange(MOST_POINTS)
    for plane in range(6):
        side = now[..., 3] + (1 if plane % 2 == 0 else -1) * now[..., plane // 2]
        there = place < count[:, None]
        following = np.where(place + 1 < count[:, None], place + 1, 0)
        after = np.take_along_axis(side, following, 1)
        keep, cross = there & (side >= 0), there & ((side < 0) != (after < 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (side / (side - after))[..., None]
            between = now + (np.take_along_axis(now, following[..., None], 1) - now) * t
        # each point gives itself, the crossing after it, both or none
        start = np.cumsum(keep.astype(int) + cross, axis=1) - keep - cross
        out = np.zeros_like(now)
        row, at = np.nonzero(keep)
        out[row, start[row, at]] = now[row, at]
        row, at = np.nonzero(cross)
        out[row, start[row, at] + keep[row, at]] = between[row, at]
        now, count = out, (keep.astype(int) + cross).sum(axis=1)
    return now, count


def densities(matrix: np.ndarray, scale: tuple[float, float], points: np.ndarray, uv: np.ndarray, corners: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pixels to a unit of the texture at most, over the clipped corners of triangles: the
    larger singular value of the projection's derivative by the texture's axes, at the
    least depth of all corners.  nan for a texture map without an area."""
    du, dv = uv[:, 1] - uv[:, 0], uv[:, 2] - uv[:, 0]
    area = du[:, 0] * dv[:, 1] - du[:, 1] * dv[:, 0]
    a, b = points[:, 1] - points[:, 0], points[:, 2] - points[:, 0]
    there = np.arange(MOST_POINTS) < count[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        along = np.stack([a * dv[:, 1:] - b * du[:, 1:], b * du[:, :1] - a * dv[:, :1]], axis=-1) / area[:, None, None]
        depth = np.where(there, corners[..., 3], np.inf).min(axis=1)
        out = np.zeros(len(points))
        for k in range(MOST_POINTS):
            w = corners[:, k, 3]
            rows = [s * (matrix[r, :3] - (corners[:, k, r] / w)[:, None] * matrix[3, :3]) for r, s in enumerate(scale)]
            j = np.einsum("rnd,nde->nre", np.stack(rows), along) / depth[:, None, None]
            p, q, r = (j[:, :, 0] ** 2).sum(axis=1), (j[:, :, 1] ** 2).sum(axis=1), (j[:, :, 0] * j[:, :, 1]).sum(axis=1)
            size = np.sqrt(np.maximum(0, (p + q + np.hypot(p - q, 2 * r)) / 2))
            out = np.where(there[:, k], np.maximum(out, np.where(depth > 1e-9, size, np.inf)), out)
    return np.where(np.abs(area) >= 1e-16, out, np.nan)


PROJECTED = "id long, state string, points int, area double, left double, top double, right double, bottom double, u0 double, v0 double, u1 double, v1 double, centre double, density double"


def project(triangles: DataFrame, matrix: list[float], width: float, height: float, cull: bool = True) -> DataFrame:
    """Triangles (id, xyz: nine values, uv: six) under a row-major camera matrix:

    id, state (culled, outside or shown), points of the clipped polygon, its area and box
    in pixels, its box in the texture, how near it comes to the middle of the view (from
    0 to 1 and beyond), and density, the pixels to a unit of texture."""
    m, scale = np.array(matrix).reshape(4, 4), (width / 2, height / 2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            points, uv = np.stack(f["xyz"].to_numpy()).reshape(-1, 3, 3), np.stack(f["uv"].to_numpy()).reshape(-1, 3, 2)
            clip = to_clip(m, points)
            polygon, count = clipped(np.concatenate([clip, uv], axis=2))
            away = faces_away(clip) if cull else np.zeros(len(f), bool)
            shown = ~away & (count >= 3)
            there = np.arange(MOST_POINTS) < count[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                nx, ny = polygon[..., 0] / polygon[..., 3], polygon[..., 1] / polygon[..., 3]
            x, y = (nx + 1) * scale[0], (1 - ny) * scale[1]
            following = np.where(np.arange(MOST_POINTS) + 1 < count[:, None], np.arange(MOST_POINTS) + 1, 0)
            turn = x * np.take_along_axis(y, following, 1) - np.take_along_axis(x, following, 1) * y
            least = lambda v: np.where(there, v, np.inf).min(axis=1)
            most = lambda v: np.where(there, v, -np.inf).max(axis=1)
            values = {
                "area": np.abs(np.where(there, turn, 0).sum(axis=1)) / 2, "left": least(x), "top": least(y), "right": most(x), "bottom": most(y),
                "u0": least(polygon[..., 4]), "v0": least(polygon[..., 5]), "u1": most(polygon[..., 4]), "v1": most(polygon[..., 5]),
                "centre": least(np.hypot(nx, ny)), "density": densities(m, scale, points, uv, polygon, count),
            }
            values = {k: pd.array(np.where(shown, v, np.nan), dtype="Float64") for k, v in values.items()}
            yield pd.DataFrame({"id": f["id"].to_numpy(), "state": np.where(away, "culled", np.where(shown, "shown", "outside")), "points": np.where(shown, count, 0).astype(np.int32), **values})

    out = triangles.select("id", "xyz", "uv").mapInPandas(run, PROJECTED)
    names = [c for c, kind in out.dtypes if kind == "double"]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def texture_density(projected: DataFrame, columns: int, rows: int) -> DataFrame:
    """(row, col, triangles, density, mean): of each cell of the texture that shown
    triangles reach into, the largest density, and the mean by their pixels."""

    def span(least: str, most: str, n: int) -> Column:
        first, last = F.floor(F.col(least) * n), F.ceil(F.col(most) * n) - 1
        return F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(F.greatest(last, first), F.lit(n - 1)).cast("int")))

    shown = projected.where("state = 'shown' and density is not null and u1 > 0 and v1 > 0").where((F.col("u0") < 1) & (F.col("v0") < 1))
    cells = shown.withColumn("row", span("v0", "v1", rows)).withColumn("col", span("u0", "u1", columns))
    return cells.groupBy("row", "col").agg(F.count("*").alias("triangles"), F.max("density").alias("density"), (F.sum(F.col("density") * F.col("area")) / F.sum("area")).alias("mean"))


def facing_blocks(triangles: DataFrame, eye: tuple[float, float, float], levels: int) -> DataFrame:
    """(level, row, col, triangles, facing) of triangles (row, col of the last level, xyz):
    1 if every triangle of a block faces the eye, -1 if none does, 0 if it can't be told.

    A block keeps the ranges of its unit normals and of its places, which are merged from
    its children's; the sign of all products within them decides for the whole block."""
    p = [[F.col("xyz")[3 * n + a] for a in range(3)] for n in range(3)]
    a, b = ([p[n][k] - p[0][k] for k in range(3)] for n in (1, 2))
    normal = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    rows = triangles.select("row", "col", "xyz", *(v.alias(f"n{k}") for k, v in enumerate(normal)))
    length = F.sqrt(F.col("n0") * F.col("n0") + F.col("n1") * F.col("n1") + F.col("n2") * F.col("n2"))
    rows = rows.withColumn("length", length).where("length > 0")
    ends = []
    for k in range(3):
        rows = rows.withColumn(f"u{k}", F.col(f"n{k}") / F.col("length")).withColumn(f"l{k}", F.least(*(q[k] for q in p))).withColumn(f"h{k}", F.greatest(*(q[k] for q in p)))
        ends += [F.min(f"u{k}").alias(f"u{k}_lo"), F.max(f"u{k}").alias(f"u{k}_hi"), F.min(f"l{k}").alias(f"p{k}_lo"), F.max(f"h{k}").alias(f"p{k}_hi")]
    now = rows.groupBy("row", "col").agg(F.count("*").alias("triangles"), *ends).withColumn("level", F.lit(levels))
    out = now
    merged = [(F.min if c.endswith("lo") else F.max)(c).alias(c) for k in range(3) for c in (f"u{k}_lo", f"u{k}_hi", f"p{k}_lo", f"p{k}_hi")]
    for level in range(levels - 1, -1, -1):
        now = now.groupBy(right(F.col("row"), 1).cast("int").alias("row"), right(F.col("col"), 1).cast("int").alias("col")).agg(F.sum("triangles").alias("triangles"), *merged).withColumn("level", F.lit(level))
        out = out.unionByName(now)
    low, high = F.lit(0.0), F.lit(0.0)
    for k, e in enumerate(eye):
        products = [F.col(f"u{k}_{s}") * (F.lit(e) - F.col(f"p{k}_{t}")) for s in ("lo", "hi") for t in ("lo", "hi")]
        low, high = low + F.least(*products), high + F.greatest(*products)
    room = MARGIN * F.sqrt(sum((F.greatest(F.abs(F.lit(e) - F.col(f"p{k}_lo")), F.abs(F.lit(e) - F.col(f"p{k}_hi"))) ** 2 for k, e in enumerate(eye)), F.lit(0.0)))
    return out.select("level", "row", "col", "triangles", F.when(low > room, 1).when(high < -room, -1).otherwise(0).alias("facing"))
