"""Polygons: hulls, clipping, areas, separation.

Convex hulls of groups are taken in two steps, the hull of each partition's share of
a group, then the hull of those hulls, so that no group is gathered whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monotone_chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, anticlockwise from the leftmost; points on an edge go."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(rows):
        out: list[tuple[float, float]] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convex_hulls(points: DataFrame, group: str) -> DataFrame:
    """points (group, x, y) -> (group, place, x, y)."""

    def corners(frame: pd.DataFrame) -> pd.DataFrame:
        hull = monotone_chain(list(zip(frame["x"], frame["y"], strict=True)))
        return pd.DataFrame({group: [frame[group].iloc[0]] * len(hull), "place": range(len(hull)), "x": [p[0] for p in hull], "y": [p[1] for p in hull]})

    def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, rows in f.groupby(group):
                yield corners(rows)[[group, "x", "y"]]

    kind = points.schema[group].dataType.simpleString()
    some = points.select(group, "x", "y").mapInPandas(share, f"{group} {kind}, x double, y double")
    return some.groupBy(group).applyInPandas(corners, f"{group} {kind}, place int, x double, y double")


def clip_half(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """The part of a ring of (x, y) points on one side of a line along an axis, the
    line included: a point stays if it is inside, and an edge that crosses adds its
    meeting point.  An empty ring stays empty."""
    other = "y" if axis == "x" else "x"

    def depth(p: Column) -> Column:
        return (p[axis] - bound) if above else (bound - p[axis])

    def piece(p: Column, k: Column) -> Column:
        following = F.get(ring, F.when(k + 1 < F.size(ring), k + 1).otherwise(0))
        share = depth(p) / (depth(p) - depth(following))
        place = {axis: bound.cast("double"), other: p[other] + (following[other] - p[other]) * share}
        meets = F.struct(place["x"].alias("x"), place["y"].alias("y"))
        own = F.when(depth(p) >= 0, F.array(p)).otherwise(F.filter(F.array(p), lambda q: F.lit(False)))
        return F.when((depth(p) < 0) != (depth(following) < 0), F.concat(own, F.array(meets))).otherwise(own)

    return F.flatten(F.transform(ring, piece))


def area(ring: Column) -> Column:
    """Twice-signed trapezia, halved; 0 for an empty ring."""

    def part(p: Column, k: Column) -> Column:
        q = F.get(ring, F.when(k + 1 < F.size(ring), k + 1).otherwise(0))
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.aggregate(F.transform(ring, part), F.lit(0.0), lambda s, v: s + v) / 2


def beyond_edge(hull: list[tuple[Column, Column]], box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether some edge of an anticlockwise hull has no corner of the box
    (u0, v0, u1, v1) strictly on its inner side."""
    out = F.lit(False)
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        sides = [(bx - ax) * (v - ay) - (by - ay) * (u - ax) for u in box[0::2] for v in box[1::2]]
        out = out | (F.greatest(*sides) <= 0)
    return out
