"""Boxes: structs of x, y, w, h in whole pixels; the far edges are outside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def area(b: Column) -> Column:
    return b["w"].cast("bigint") * b["h"]


def overlaps(a: Column, b: Column) -> Column:
    """Whether the interiors meet."""
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < bottom(b)) & (b["y"] < bottom(a))


def intersection(a: Column, b: Column) -> Column:
    """The common box, or null."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    return F.when(overlaps(a, b), box(x, y, F.least(right(a), right(b)) - x, F.least(bottom(a), bottom(b)) - y))


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The common area as a share of the smaller box."""
    return F.coalesce(area(intersection(a, b)) / F.least(area(a), area(b)), F.lit(0.0))


def contains(outer: Column, inner: Column) -> Column:
    return (inner["x"] >= outer["x"]) & (inner["y"] >= outer["y"]) & (right(inner) <= right(outer)) & (bottom(inner) <= bottom(outer))
