"""Boxes and polygons as Column expressions. A box is a struct of x0, y0, x1, y1; points are a flat array x, y, x, y ..."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_of(points: Column) -> Column:
    """The box around a flat array of points."""
    x = F.filter(points, lambda v, i: (i % 2 == 0) & v.isNotNull())
    y = F.filter(points, lambda v, i: (i % 2 == 1) & v.isNotNull())
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for an empty union."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def contains(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def clamp(b: Column, width: Column, height: Column) -> Column:
    """The box within the picture, or null where nothing of it is."""
    lo = lambda v, m: F.least(F.greatest(v, F.lit(0.0)), m)
    out = F.struct(lo(b["x0"], width).alias("x0"), lo(b["y0"], height).alias("y0"), lo(b["x1"], width).alias("x1"), lo(b["y1"], height).alias("y1"))
    return F.when((out["x1"] > out["x0"]) & (out["y1"] > out["y0"]), out)


def polygon_area(points: Column) -> Column:
    """Area of a simple polygon (the shoelace formula)."""
    n = F.size(points)
    term = lambda i: points[i] * points[(i + 3) % n] - points[(i + 2) % n] * points[i + 1]
    corners = F.transform(F.sequence(F.lit(0), n - 2, F.lit(2)), term)
    return F.when(n >= 6, F.abs(F.aggregate(corners, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(0.0)


def is_rectangle(points: Column) -> Column:
    """Whether a polygon of four corners is an axis-aligned rectangle."""
    x = F.array_distinct(F.filter(points, lambda _, i: i % 2 == 0))
    y = F.array_distinct(F.filter(points, lambda _, i: i % 2 == 1))
    return (F.size(points) == 8) & (F.size(x) == 2) & (F.size(y) == 2)


def principal_angle(x: Column, y: Column) -> Column:
    """Aggregate: direction of the points' largest variance, in radians."""
    return 0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def scaled_polygon(points: Column, width: Column, height: Column) -> Column:
    """The points as shares of the picture's width and height, or null for what is no polygon inside the picture:
    an odd number of values or fewer than three different points, values that are no numbers, no area, points outside."""
    x, y = F.filter(points, lambda _, i: i % 2 == 0), F.filter(points, lambda _, i: i % 2 == 1)
    inside = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= width)) & F.forall(y, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= height))
    sound = (width > 0) & (height > 0) & (F.size(points) >= 6) & (F.size(points) % 2 == 0) & inside & (F.size(F.array_distinct(F.arrays_zip(x, y))) >= 3)
    return F.when(sound & (polygon_area(points) > 1e-9), F.transform(points, lambda v, i: v / F.when(i % 2 == 0, width).otherwise(height)))
