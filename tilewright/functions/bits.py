"""Shifts whose count may be a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(n: Column | int) -> Column:
    return F.lit(n) if isinstance(n, int) else n.cast("int")


def left(v: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", v, _count(n))


def right(v: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", v, _count(n))
