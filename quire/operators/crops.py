"""Crops around lines: clearance to neighbours, padding and image-service addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g

LONGITUDINAL, TRANSVERSE = 0.04, 0.08


def transverse_clearance(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """Free distance of each box to its nearest neighbour before and after it across the writing direction.

    Neighbours are boxes of the page that share a part of the longitudinal extent; null means no limit. Columns are those
    of ``boxes`` with ``before`` and ``after``. The join is by page, so a page meets only its own boxes.
    """
    a = boxes.select(page, "det_idx", g.box().alias("a"))
    b = boxes.select(page, g.box().alias("b"))
    vertical = F.col("a.height") > F.col("a.width")
    pick = lambda c, axis_v, axis_h, f: F.when(vertical, f(F.col(c), axis_v)).otherwise(f(F.col(c), axis_h))
    start = lambda box, axis: box[axis]
    along = F.least(pick("a", "y", "x", g.end), pick("b", "y", "x", g.end)) > F.greatest(pick("a", "y", "x", start), pick("b", "y", "x", start))
    before = pick("a", "x", "y", start) - pick("b", "x", "y", g.end)
    after = pick("b", "x", "y", start) - pick("a", "x", "y", g.end)
    near = a.join(b, page).where(along & ((before >= 0) | (after >= 0)))
    limits = near.groupBy(page, "det_idx").agg(F.min(F.when(before >= 0, before)).alias("before"), F.min(F.when(after >= 0, after)).alias("after"))
    return boxes.join(limits, [page, "det_idx"], "left")


def expand(b: Column, before: Column, after: Column, longitudinal: float = LONGITUDINAL, transverse: float = TRANSVERSE) -> Column:
    """A box with padding; across the writing direction at most half of the clearance is taken."""
    vertical = b["height"] > b["width"]
    long_pad = F.greatest(F.lit(0.0), F.when(vertical, b["height"]).otherwise(b["width"])) * max(0.0, longitudinal)
    wide_pad = F.greatest(F.lit(0.0), F.when(vertical, b["width"]).otherwise(b["height"])) * max(0.0, transverse)
    first, second = F.least(wide_pad, before / 2), F.least(wide_pad, after / 2)  # least() skips null
    x0, x1 = F.when(vertical, first).otherwise(long_pad), F.when(vertical, second).otherwise(long_pad)
    y0, y1 = F.when(vertical, long_pad).otherwise(first), F.when(vertical, long_pad).otherwise(second)
    return g.make_box(b["x"] - x0, b["y"] - y0, b["width"] + x0 + x1, b["height"] + y0 + y1)


def expand_in(b: Column, before: Column, after: Column, width: Column, height: Column, **padding: float) -> Column:
    """As :func:`expand`, clipped to an image."""
    p = expand(b, before, after, **padding)
    w, h = F.greatest(F.lit(0.0), width), F.greatest(F.lit(0.0), height)
    x1, y1 = g.clamp(p["x"], 0, w), g.clamp(p["y"], 0, h)
    x2, y2 = g.clamp(g.end(p, "x"), x1, w), g.clamp(g.end(p, "y"), y1, h)
    return g.make_box(x1, y1, x2 - x1, y2 - y1)


def _whole(v: Column) -> Column:
    return v.cast("long").cast("string")


def line_crop_url(service: Column, page_width: Column, page_height: Column, image_width: Column, image_height: Column, expanded: Column, max_size: int = 1024) -> Column:
    """Address of a line's crop in page pixels; empty without a service or sizes. ``expanded`` is in image pixels."""
    inner = g.whole_pixels(expanded, image_width, image_height)
    sx, sy = page_width / F.when(image_width > 0, image_width), page_height / F.when(image_height > 0, image_height)
    out = g.whole_pixels(g.scaled(inner, sx, sy), page_width, page_height)
    size = str(max(1, int(max_size // 1)))
    url = F.concat(
        F.regexp_replace(service, "/$", ""), F.lit("/"), F.concat_ws(",", *[_whole(out[c]) for c in ("x", "y", "width", "height")]), F.lit(f"/!{size},{size}/0/default.jpg")
    )
    usable = (F.length(service) > 0) & (page_width > 0) & (page_height > 0) & (image_width > 0) & (image_height > 0)
    return F.when(F.coalesce(usable, F.lit(False)), url).otherwise(F.lit(""))


def percent_crop_url(service: Column, page_width: Column, page_height: Column, region: Column) -> Column:
    """Address of a crop given in percent of the page; null without a service or sizes."""
    x = g.clamp(g.rounded(region["x"] / 100 * page_width), 0, page_width - 1)
    y = g.clamp(g.rounded(region["y"] / 100 * page_height), 0, page_height - 1)
    w = g.clamp(g.rounded(region["width"] / 100 * page_width), 1, page_width - x)
    h = g.clamp(g.rounded(region["height"] / 100 * page_height), 1, page_height - y)
    url = F.concat(F.regexp_replace(service, "/$", ""), F.lit("/"), F.concat_ws(",", *[_whole(v) for v in (x, y, w, h)]), F.lit("/!512,512/0/default.jpg"))
    return F.when((F.length(service) > 0) & (page_width > 0) & (page_height > 0), url)


def page_image_url(service: Column, fallback: Column, width: int = 2000) -> Column:
    """Address of a page image of a given width, or the fallback without a service."""
    return F.when(F.length(service) > 0, F.concat(F.regexp_replace(service, "/$", ""), F.lit(f"/full/{width},/0/default.jpg"))).otherwise(fallback)


def dragged_region(x0: Column, y0: Column, x1: Column, y1: Column, least: float = 0.4) -> Column:
    """Rectangle of two corners in percent; null under ``least`` percent on a side."""
    b = g.make_box(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))
    return F.when((b["width"] >= least) & (b["height"] >= least), b)
