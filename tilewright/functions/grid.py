"""Diamond grid and quadtree keys as column expressions.

A grid point is a struct (i, j, k) of signed integers on a cube of half-width
2^28.  A diamond has four corners c0..c3; its id is the midpoint of c0 and c2,
its parents are c1 and c3.  Sums are taken in 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.bits import left, right

HALF = 1 << 28
INVALID = -(1 << 29)
AXES = ("i", "j", "k")
MOST_LEVEL = 27
# fixed values: corner points of the roots
PLANAR_ROOT = ((-HALF, -HALF, HALF), (-HALF, HALF, HALF), (HALF, HALF, HALF), (HALF, -HALF, HALF))
_Q = HALF // 2
CYLINDER_POINTS = (
    (-_Q, -HALF, _Q), (_Q, -HALF, _Q), (-_Q, 0, _Q), (_Q, 0, _Q), (-_Q, HALF, _Q), (_Q, HALF, _Q),
    (-_Q, -HALF, -_Q), (_Q, -HALF, -_Q), (-_Q, 0, -_Q), (_Q, 0, -_Q), (-_Q, HALF, -_Q), (_Q, HALF, -_Q),
)
CYLINDER_ROOTS = ((2, 4, 5, 3), (9, 3, 5, 11), (9, 11, 10, 8), (2, 8, 10, 4), (2, 3, 1, 0), (9, 7, 1, 3), (9, 8, 6, 7), (2, 0, 6, 8))


def point(i: Column, j: Column, k: Column) -> Column:
    return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), k.cast("long").alias("k"))


def is_point(p: Column) -> Column:
    return (p["i"] != INVALID) | (p["j"] != INVALID) | (p["k"] != INVALID)


def midpoint(a: Column, b: Column) -> Column:
    """Rounded towards minus infinity on each axis."""
    return F.struct(*[right(a[x] + b[x], 1).alias(x) for x in AXES])


def reflect(p: Column, centre: Column) -> Column:
    """The point on the other side of p, seen from the centre."""
    return F.struct(*[(2 * p[x] - centre[x]).alias(x) for x in AXES])


def diamond(c0: Column, c1: Column, c2: Column, c3: Column) -> Column:
    return F.struct(c0.alias("c0"), c1.alias("c1"), c2.alias("c2"), c3.alias("c3"))


def diamond_id(d: Column) -> Column:
    return midpoint(d["c0"], d["c2"])


def parent_id(d: Column, fragment: int) -> Column:
    return d[f"c{1 + 2 * fragment}"]


def child_id(d: Column, fragment: int, child: int) -> Column:
    """Null where a corner is invalid."""
    a, b = d[f"c{2 * fragment + child}"], d[f"c{(2 * fragment + child + 1) % 4}"]
    return F.when(is_point(a) & is_point(b), midpoint(a, b))


def planar_child(d: Column, fragment: int, child: int) -> Column:
    """The child diamond: it keeps the shared parent and one neighbour corner,
    the centre becomes a parent, and the last corner mirrors the centre."""
    centre, mid = diamond_id(d), child_id(d, fragment, child)
    far = reflect(mid, centre)
    own, prev, following = d[f"c{1 + 2 * fragment}"], d[f"c{2 * fragment}"], d[f"c{(2 + 2 * fragment) % 4}"]
    return diamond(own, centre, prev, far) if child == 0 else diamond(own, far, following, centre)


def wrap_cylinder(p: Column) -> Column:
    """Folds a point that left a face round the edge onto the next face."""
    fields = {x: p[x] for x in AXES}
    low, high = -_Q, _Q
    out = F.struct(*[fields[x].alias(x) for x in AXES])

    def folded(axis: str, other: str) -> Column:
        over = F.when(p[axis] < low, low - p[axis]).otherwise(p[axis] - high)
        kept = F.when(p[axis] < low, F.lit(low)).otherwise(F.lit(high)).cast("long")
        moved = F.when(p[other] == high, p[other] - over).when(p[other] == low, p[other] + over).otherwise(p[other])
        return F.struct(*[(kept if x == axis else moved if x == other else p[x]).alias(x) for x in AXES])

    def leaves(axis: str) -> Column:
        return (p[axis] < low) | (p[axis] > high)

    return F.when(leaves("i"), folded("i", "k")).when(leaves("k"), folded("k", "i")).otherwise(out)


def cylinder_child(d: Column, fragment: int, child: int) -> Column:
    c = planar_child(d, fragment, child)
    return diamond(c["c0"], wrap_cylinder(c["c1"]), c["c2"], wrap_cylinder(c["c3"]))


def grid_degrees(p: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of a point of the cylinder, its four faces unrolled."""
    i, k = p["i"].cast("double"), p["k"].cast("double")
    along = F.when(p["k"] == _Q, i + _Q - 2.0 * HALF).when(p["i"] == _Q, _Q - k - 1.0 * HALF).when(p["k"] == -_Q, _Q - i).when(p["i"] == -_Q, k + _Q + 1.0 * HALF).otherwise(0.0)
    return along * (90.0 / HALF), p["j"].cast("double") * (90.0 / HALF)


def degrees_grid(lon: Column, lat: Column) -> Column:
    """The inverse, with real coordinates (x, y, z); faces are half-open."""
    g, h = float(HALF), float(_Q)
    y = lat * g / 90.0
    x = F.when(lon < -90, -h + (lon + 180.0) * g / 90.0).when(lon < 0, F.lit(h)).when(lon < 90, h - lon * g / 90.0).otherwise(F.lit(-h))
    z = F.when(lon < -90, F.lit(h)).when(lon < 0, h - (lon + 90.0) * g / 90.0).when(lon < 90, F.lit(-h)).otherwise(-h + (lon - 90.0) * g / 90.0)
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def plane_grid(u: Column, v: Column, bounds: tuple[float, float, float, float]) -> Column:
    g = float(HALF)
    return F.struct((-g + 2 * g * (u - bounds[0]) / (bounds[2] - bounds[0])).alias("x"), (-g + 2 * g * (v - bounds[1]) / (bounds[3] - bounds[1])).alias("y"), F.lit(g).alias("z"))


def triangle_index(x: Column, y: Column, n: Column) -> Column:
    """Place of (x, y) in a packed triangle of n + 1 rows."""
    return (right(y * (2 * n + 3 - y), 1) + x).cast("int")


# quadtree nodes

def is_node(level: Column, row: Column, col: Column) -> Column:
    return level.between(0, MOST_LEVEL) & (row >= 0) & (col >= 0) & (row < left(F.lit(2).cast("long"), level)) & (col < left(F.lit(4).cast("long"), level))


def node_root(level: Column, row: Column, col: Column, whole_globe: bool = True) -> Column:
    """Number of the root above a node, row by row; -1 for no node."""
    root = right(row, level) * (4 if whole_globe else 1) + right(col, level)
    return F.when(is_node(level, row, col), root).otherwise(-1).cast("int")


def node_bounds(level: Column, row: Column, col: Column, extent: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0), whole_globe: bool = True) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north); rows count from the north."""
    scale = F.pow(F.lit(2.0), level)
    width = (extent[2] - extent[0]) / ((4 if whole_globe else 1) * scale)
    height = (extent[3] - extent[1]) / ((2 if whole_globe else 1) * scale)
    x, y = extent[0] + col * width, extent[3] - row * height
    return x, y - height, x + width, y


def ancestors(level: Column, row: Column, col: Column) -> Column:
    """Array of (level, row, col) structs above a node, nearest first."""
    ups = F.when(level > 0, F.sequence(F.lit(1), level)).otherwise(F.array().cast("array<int>"))
    return F.transform(ups, lambda up: F.struct((level - up).alias("level"), right(row, up).alias("row"), right(col, up).alias("col")))


def anchor(d: Column, level: Column, fragment: int, whole_globe: bool = True) -> tuple[Column, Column, Column]:
    """The quadtree node (level, row, col) that a grid diamond stands in; nulls if none."""
    p = F.when(level % 2 == 1, parent_id(d, fragment)).otherwise(diamond_id(d))
    i, j, k = (p[x].cast("double") for x in AXES)
    depth = right(level, 1)
    scale = F.pow(F.lit(2.0), depth)
    g, h = float(HALF), float(_Q)
    if whole_globe:
        x = F.when(p["k"] == _Q, (i + h) / g).when(p["i"] == _Q, 1 + (h - k) / g).when(p["k"] == -_Q, 2 + (h - i) / g).when(p["i"] == -_Q, 3 + (k + h) / g)
        y = (g - j) / g
    else:
        x, y = (i + g) / (2 * g), (g - j) / (2 * g)
    row, col = F.floor(y * scale), F.floor(x * scale)
    inside = x.isNotNull() & (row >= 0) & (col >= 0) & (row < (2 if whole_globe else 1) * scale) & (col < (4 if whole_globe else 1) * scale)
    return F.when(inside, depth).cast("int"), F.when(inside, row).cast("int"), F.when(inside, col).cast("int")


def spread3(v: Column) -> Column:
    """Spreads the low 16 bits of v so that two zero bits follow each."""
    out = F.lit(0).cast("long")
    for b in range(16):
        out = out.bitwiseOR(left(right(v, b).bitwiseAND(F.lit(1).cast("long")), 3 * b))
    return out


def morton(i: Column, j: Column, k: Column) -> tuple[Column, Column]:
    """(high, low) 48-bit halves of the interleaved coordinates, offset by 2^28."""
    parts = [v.cast("long") + HALF for v in (i, j, k)]

    def half(shift: int) -> Column:
        x, y, z = (spread3(right(v, shift).bitwiseAND(F.lit(0xFFFF).cast("long"))) for v in parts)
        return x.bitwiseOR(left(y, 1)).bitwiseOR(left(z, 2))

    return half(16), half(0)


def gray(v: Column) -> Column:
    return v.bitwiseXOR(right(v, 1))


def log2_floor(v: Column) -> Column:
    """Exact for positive integers; null otherwise."""
    return F.when(v > 0, F.length(F.bin(v)) - 1)


def reverse_bits32(v: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v), 32, "0")), 2, 10).cast("long")


def sample_spacing(d: Column, fragment: int, dimension: int, scale: tuple[float, float, float]) -> Column:
    """Longest edge of a fragment's triangle in metres, over the samples along it;
    the scale gives the metres of a grid unit on each axis."""
    ring = [d[f"c{k % 4}"] for k in (2 * fragment, 2 * fragment + 1, 2 * fragment + 2)]

    def edge(a: Column, b: Column) -> Column:
        steps = [(a[x] - b[x]).cast("double") * s for x, s in zip(AXES, scale, strict=True)]
        return steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]

    return F.sqrt(F.greatest(edge(ring[0], ring[1]), edge(ring[1], ring[2]), edge(ring[2], ring[0]))) / dimension
