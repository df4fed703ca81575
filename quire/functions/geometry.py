"""Box algebra as Column expressions. A box is a struct with x, y, width and height (doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,width:double,height:double>"
AXES = {"x": "width", "y": "height"}


def box(prefix: str = "") -> Column:
    """A box from the columns x, y, width and height."""
    return F.struct(*[F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")])


def make_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def clamp(value: Column, low, high) -> Column:
    """Between ``low`` and ``high``; ``high`` wins if they cross."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.least(high, F.greatest(low, value))


def end(b: Column, axis: str) -> Column:
    return b[axis] + b[AXES[axis]]


def center(b: Column, axis: str) -> Column:
    return b[axis] + b[AXES[axis]] / 2


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["width"]) * F.greatest(F.lit(0.0), b["height"])


def overlap_along(a: Column, b: Column, axis: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(end(a, axis), end(b, axis)) - F.greatest(a[axis], b[axis]))


def intersection(a: Column, b: Column) -> Column:
    return overlap_along(a, b, "x") * overlap_along(a, b, "y")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without area."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def overlap_over_smaller(a: Column, b: Column) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def clip(b: Column, width: Column, height: Column) -> Column:
    """The part of a box inside a page; empty boxes collapse to a point on its edge."""
    x1, y1 = clamp(b["x"], 0, width), clamp(b["y"], 0, height)
    x2 = F.greatest(x1, F.least(width, end(b, "x")))
    y2 = F.greatest(y1, F.least(height, end(b, "y")))
    return make_box(x1, y1, x2 - x1, y2 - y1)


def whole_pixels(b: Column, width: Column, height: Column) -> Column:
    """Grow a box outward to whole pixels and clip it to the image."""
    w, h = (F.greatest(F.lit(0.0), F.floor(v).cast("double")) for v in (width, height))
    x1, y1 = clamp(F.floor(b["x"]).cast("double"), 0, w), clamp(F.floor(b["y"]).cast("double"), 0, h)
    x2 = clamp(F.ceil(end(b, "x")).cast("double"), x1, w)
    y2 = clamp(F.ceil(end(b, "y")).cast("double"), y1, h)
    return make_box(x1, y1, x2 - x1, y2 - y1)


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return make_box(b["x"] * sx, b["y"] * sy, b["width"] * sx, b["height"] * sy)


def restore(tile: Column, local: Column, width: Column, height: Column) -> Column:
    """A box in tile coordinates as a box in page coordinates."""
    return clip(make_box(tile["x"] + local["x"], tile["y"] + local["y"], local["width"], local["height"]), width, height)


def rounded(value: Column) -> Column:
    """Round halves up, also below zero."""
    return F.floor(value + 0.5).cast("double")


def aspect(b: Column) -> Column:
    """Long side over short side, the short side counting as 1 at least."""
    return F.greatest(b["width"], b["height"]) / F.greatest(F.lit(1.0), F.least(b["width"], b["height"]))
