"""Half-open boxes as structs ``(x, y, width, height)`` and expressions over them.

Boxes are [x, x + width) x [y, y + height); touching boxes do not intersect and have a gap of 0.
A null box or member makes the result null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return b["width"].cast("bigint") * b["height"]


def is_box(b: Column) -> Column:
    """A box with all members, not negative in place and at least one pixel large."""
    return F.coalesce((b["x"] >= 0) & (b["y"] >= 0) & (b["width"] >= 1) & (b["height"] >= 1), F.lit(False))


def contains(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x"]) & (x < right(b)) & (y >= b["y"]) & (y < bottom(b))


def _from_edges(left: Column, top: Column, end: Column, low: Column) -> Column:
    return F.when((end > left) & (low > top), box(left, top, end - left, low - top))


def intersection(a: Column, b: Column) -> Column:
    """The common box, or null where there is none."""
    return _from_edges(
        F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), F.least(right(a), right(b)), F.least(bottom(a), bottom(b))
    )


def intersection_over_union(a: Column, b: Column) -> Column:
    """Common area over joint area; 0.0 if disjoint."""
    common = interval_overlap(a["x"], right(a), b["x"], right(b)).cast("bigint") * interval_overlap(a["y"], bottom(a), b["y"], bottom(b))
    return common.cast("double") / (area(a) + area(b) - common)


def clipped(b: Column, width: Column, height: Column) -> Column:
    """The part of a box inside an image, or null."""
    return _from_edges(F.greatest(b["x"], F.lit(0)), F.greatest(b["y"], F.lit(0)), F.least(right(b), width), F.least(bottom(b), height))


def padded(b: Column, padding: Column, width: Column, height: Column) -> Column:
    """A box grown by ``padding`` on all sides and clipped to the image."""
    zero = F.lit(0)
    return _from_edges(
        F.greatest(b["x"] - padding, zero), F.greatest(b["y"] - padding, zero),
        F.least(right(b) + padding, width), F.least(bottom(b) + padding, height),
    )


def interval_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def interval_gap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0), start_b - end_a, start_a - end_b)


def horizontal_gap(a: Column, b: Column) -> Column:
    return interval_gap(a["x"], right(a), b["x"], right(b))


def vertical_gap(a: Column, b: Column) -> Column:
    return interval_gap(a["y"], bottom(a), b["y"], bottom(b))


def vertical_overlap_ratio(a: Column, b: Column) -> Column:
    """Overlap in y over the shorter height."""
    return interval_overlap(a["y"], bottom(a), b["y"], bottom(b)) / F.least(a["height"], b["height"]).cast("double")


def center_y(b: Column) -> Column:
    return b["y"] + b["height"] / F.lit(2.0)


def center_x(b: Column) -> Column:
    return b["x"] + b["width"] / F.lit(2.0)


def vertical_center_distance(a: Column, b: Column) -> Column:
    return F.abs(center_y(a) - center_y(b))


def union_box(b: Column) -> Column:
    """Aggregate: the smallest box around all boxes of the group; null over none."""
    left, top = F.min(b["x"]), F.min(b["y"])
    return F.when(left.isNotNull(), box(left, top, F.max(right(b)) - left, F.max(bottom(b)) - top))


def rotated(b: Column, matrix: list[list[float]], width: Column, height: Column) -> Column:
    """Box around the four corners under a 2x3 matrix, rounded outwards and clipped; null if outside."""
    (a, c, e), (d, g, f) = matrix
    xs, ys = [], []
    for cx in (b["x"], right(b)):
        for cy in (b["y"], bottom(b)):
            xs.append(cx * a + cy * c + e)
            ys.append(cx * d + cy * g + f)
    zero = F.lit(0)
    return _from_edges(
        F.greatest(zero, F.floor(F.least(*xs)).cast("int")), F.greatest(zero, F.floor(F.least(*ys)).cast("int")),
        F.least(width, F.ceil(F.greatest(*xs)).cast("int")), F.least(height, F.ceil(F.greatest(*ys)).cast("int")),
    )
