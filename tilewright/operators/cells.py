"""Range predicates as equi-joins: boxes are cut into the cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def cover(boxes: DataFrame, size: float, box: tuple[str, str, str, str] = ("west", "south", "east", "north")) -> DataFrame:
    """Each box once for every cell that it touches, as cell_x and cell_y."""
    w, s, e, n = box
    rows = boxes.withColumn("cell_x", F.explode(F.sequence(cell(F.col(w), size), cell(F.col(e), size))))
    return rows.withColumn("cell_y", F.explode(F.sequence(cell(F.col(s), size), cell(F.col(n), size))))


def box_join(boxes: DataFrame, points: DataFrame, size: float, closed: bool = False) -> DataFrame:
    """Boxes with the points (lon, lat) inside them; open boxes unless ``closed``.

    A point lies in one cell, so no pair comes twice."""
    rows = points.withColumn("cell_x", cell(F.col("lon"), size)).withColumn("cell_y", cell(F.col("lat"), size))
    both = cover(boxes, size).join(rows, ["cell_x", "cell_y"]).drop("cell_x", "cell_y")
    if closed:
        return both.where("lon >= west and lon <= east and lat >= south and lat <= north")
    return both.where("lon > west and lon < east and lat > south and lat < north")


def search_places(places: DataFrame, text: str, box: tuple[float, float, float, float], skip: int = 0, most: int = 100, order: str = "id") -> DataFrame:
    """Places in a closed box whose name holds ``text`` without regard to case, by pages.

    In ``text``, ``*`` stands for any characters and ``?`` for one."""
    found = places.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    if text:
        if "*" in text or "?" in text:
            pattern = "".join("%" if c == "*" else "_" if c == "?" else f"\\{c}" if c in "%_\\" else c for c in text.lower())
            found = found.where(F.lower("name").like(f"%{pattern}%"))
        else:
            found = found.where(F.instr(F.lower("name"), text.lower()) > 0)
    return found.orderBy(order).offset(skip).limit(most)
