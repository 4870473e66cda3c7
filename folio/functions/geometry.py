"""Boxes as four columns x0, y0, x1, y1 with a prefix, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def area(prefix: str = "") -> Column:
    x0, y0, x1, y1 = box(prefix)
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def intersection(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    return F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))


def overlap_share(a: str, b: str) -> Column:
    """Intersection over the smaller area; 0 for an empty box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    both = intersection(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def boxes_meet(a: str, b: str, margin: float = 0.0) -> Column:
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    return (ax0 - margin <= bx1) & (bx0 - margin <= ax1) & (ay0 - margin <= by1) & (by0 - margin <= ay1)


def contains(outer: str, inner: str, tolerance: float = 0.0) -> Column:
    ox0, oy0, ox1, oy1 = box(outer)
    ix0, iy0, ix1, iy1 = box(inner)
    return (ix0 >= ox0 - tolerance) & (iy0 >= oy0 - tolerance) & (ix1 <= ox1 + tolerance) & (iy1 <= oy1 + tolerance)


def centre_x(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x0") + F.col(f"{prefix}x1")) / 2


def centre_y(prefix: str = "") -> Column:
    return (F.col(f"{prefix}y0") + F.col(f"{prefix}y1")) / 2


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates: the box around a group's boxes."""
    return [F.min(f"{prefix}x0").alias("x0"), F.min(f"{prefix}y0").alias("y0"), F.max(f"{prefix}x1").alias("x1"), F.max(f"{prefix}y1").alias("y1")]


def normalized(width: Column | str, height: Column | str, prefix: str = "") -> Column:
    """struct<x0, y0, x1, y1> scaled to the page and clamped to [0, 1]."""
    width, height = (F.col(c) if isinstance(c, str) else c for c in (width, height))
    clamp = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))
    x0, y0, x1, y1 = box(prefix)
    return F.struct(clamp(x0, width).alias("x0"), clamp(y0, height).alias("y0"), clamp(x1, width).alias("x1"), clamp(y1, height).alias("y1"))


def to_pixels(scale_x: Column, scale_y: Column, page_height: Column, prefix: str = "") -> Column:
    """struct of pixel coordinates from points with the origin at the bottom left."""
    x0, y0, x1, y1 = box(prefix)
    return F.struct((x0 * scale_x).cast("int").alias("x0"), ((page_height - y1) * scale_y).cast("int").alias("y0"), (x1 * scale_x).cast("int").alias("x1"), ((page_height - y0) * scale_y).cast("int").alias("y1"))


def nearest_gap_x(x0: Column, char_width: Column, n_chars: Column, target: Column) -> Column:
    """Of the n+1 gaps between a line's characters (evenly spaced), the x nearest the target; ties to the left."""
    gaps = F.transform(F.sequence(F.lit(0), n_chars), lambda i: F.struct(F.abs(x0 + i * char_width - target).alias("d"), i.alias("i"), (x0 + i * char_width).alias("x")))
    return F.array_min(gaps)["x"]
