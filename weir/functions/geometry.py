"""Plane geometry as column expressions: shapes, distances, crop windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = Sequence[tuple[float, float]]


def bounds(shapes: Sequence[Shape]) -> tuple[float, float, float, float]:
    """Box around all points of all shapes."""
    xs, ys = zip(*(p for s in shapes for p in s))
    return min(xs), min(ys), max(xs), max(ys)


def shape_bounds(points: str | Column) -> Column:
    """Box around the points of an array<array<array<int>>> column (shape, point, coordinate)."""
    flat = F.flatten(F.col(points) if isinstance(points, str) else points)
    xs, ys = F.transform(flat, lambda p: p[0]), F.transform(flat, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def crop_box(box: Column, width: Column | int, height: Column | int, scale: float = 3.0) -> Column:
    """A box scaled about its centre, cut at the frame, whole pixels towards zero."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    cx, cy = (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2
    hw, hh = (box["x2"] - box["x1"]) * (scale / 2), (box["y2"] - box["y1"]) * (scale / 2)
    return F.struct(
        F.greatest((cx - hw).cast("int"), F.lit(0)).alias("x1"),
        F.greatest((cy - hh).cast("int"), F.lit(0)).alias("y1"),
        F.least((cx + hw).cast("int"), w).alias("x2"),
        F.least((cy + hh).cast("int"), h).alias("y2"),
    )


def _edges(shape: Shape):
    return list(zip(shape, [*shape[1:], shape[0]]))


def inside(shape: Shape, x: Column, y: Column) -> Column:
    """Whether a point lies in a shape, by counting crossed edges."""
    crossed = []
    for (ax, ay), (bx, by) in _edges(shape):
        if ay == by:
            continue
        at = F.lit(float(ax)) + (y - ay) * (float(bx - ax) / float(by - ay))
        crossed.append((((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at)).cast("int"))
    return reduce(lambda a, b: a + b, crossed) % 2 == 1


def edge_distance(shape: Shape, x: Column, y: Column) -> Column:
    """Distance to the nearest edge of a shape."""
    out = []
    for (ax, ay), (bx, by) in _edges(shape):
        dx, dy = float(bx - ax), float(by - ay)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        ex, ey = x - (F.lit(float(ax)) + t * dx), y - (F.lit(float(ay)) + t * dy)
        out.append(F.sqrt(ex * ex + ey * ey))
    return F.least(*out)


def region_distance(shapes: Sequence[Shape], x: Column, y: Column) -> Column:
    """0 inside any shape, else the distance to the nearest edge of all."""
    far = [F.when(inside(s, x, y), F.lit(0.0)).otherwise(edge_distance(s, x, y)) for s in shapes]
    return F.least(*far) if len(far) > 1 else far[0]


def crop_window(box: dict[str, Column], width: int, height: int, pad: float = 0.5, least: float = 150.0) -> Column:
    """A box grown by ``pad`` of its long side, at least ``least`` wide and high, slid (not shrunk) into the frame; whole pixels, cut towards zero."""
    x1, y1, x2, y2 = (box[k] for k in ("x1", "y1", "x2", "y2"))
    grow = F.greatest(x2 - x1, y2 - y1) * pad
    w = F.least(F.greatest(x2 - x1 + grow * 2, F.lit(least)), F.lit(float(width)))
    h = F.least(F.greatest(y2 - y1 + grow * 2, F.lit(least)), F.lit(float(height)))
    left = F.least(F.greatest((x1 + x2) / 2 - w / 2, F.lit(0.0)), F.lit(float(width)) - w)
    top = F.least(F.greatest((y1 + y2) / 2 - h / 2, F.lit(0.0)), F.lit(float(height)) - h)
    return F.struct(*[v.cast("long").alias(k) for k, v in (("x1", left), ("y1", top), ("x2", left + w), ("y2", top + h))])


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def shift_box(box: Column, x0: Column, y0: Column) -> Column:
    """A box (array of 4) moved by a crop's origin, to one decimal."""
    return F.transform(box, lambda v, i: F.bround(v + F.when(i % 2 == 0, x0).otherwise(y0), 1))
