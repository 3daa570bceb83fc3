"""Planar geometry as column expressions: nothing here leaves whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_M = 0.001  # fixed value: a distance is compared with a norm to 1 mm


def col(value: Column | str | float | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def hypot2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def point_distance(ax, ay, bx, by) -> Column:
    return hypot2(col(ax) - col(bx), col(ay) - col(by))


def segment_distance(px="x", py="y", x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Distance from a point to a segment: projection clamped to the segment."""
    px, py, x1, y1, x2, y2 = (col(c) for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    norm = dx * dx + dy * dy
    along = F.when(norm == 0, F.lit(0.0)).otherwise(((px - x1) * dx + (py - y1) * dy) / norm)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return hypot2(px - (x1 + t * dx), py - (y1 + t * dy))


def ray_crosses(px="x", py="y", x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """1 when the rightward ray from the point crosses the edge (half-open in y)."""
    px, py, x1, y1, x2, y2 = (col(c) for c in (px, py, x1, y1, x2, y2))
    straddles = (y1 > py) != (y2 > py)
    at = x1 + (py - y1) / F.when(y1 == y2, F.lit(None)).otherwise(y2 - y1) * (x2 - x1)
    return F.when(straddles & (px < at), 1).otherwise(0)


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    ax, ay, bx, by, cx, cy = (col(c) for c in (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(a: tuple, b: tuple) -> Column:
    """Proper crossing of two segments given as (x1, y1, x2, y2)."""
    o1 = orientation(a[0], a[1], a[2], a[3], b[0], b[1])
    o2 = orientation(a[0], a[1], a[2], a[3], b[2], b[3])
    o3 = orientation(b[0], b[1], b[2], b[3], a[0], a[1])
    o4 = orientation(b[0], b[1], b[2], b[3], a[2], a[3])
    return (o1 * o2 < 0) & (o3 * o4 < 0)


def segment_length(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return point_distance(x1, y1, x2, y2)


def cell_of(value, size: float) -> Column:
    return F.floor(col(value) / F.lit(float(size))).cast("long")


def cell_range(low: Column, high: Column, size: float) -> Column:
    return F.sequence(cell_of(low, size), cell_of(high, size))
