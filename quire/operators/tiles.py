"""Adaptive tiles over pages with suspicious regions, and windows over long lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import geometry as g
from quire.plans.config import TILES

OVERLAP = 0.15


def adaptive_tiles(regions: DataFrame, profile: str, page: str = "page_id", width: str = "page_width", height: str = "page_height") -> DataFrame:
    """The tiles that cover most of a page's suspicious regions: page, tile_id, x, y, width, height, coverage, rank.

    ``regions`` has a row per region with its page's size. Tall pages have 3 x 1 tiles, others 2 x 2, overlapping by 15 %.
    Only tiles that touch a region count; ties go to the lower id. Coverages tie where they are equal to six places, as the
    last digits of a sum depend on the order of its regions. The fast profile has no tiles.
    """
    limit = TILES.get(profile, TILES["balanced"])
    pages = regions.groupBy(page).agg(F.max(width).cast("double").alias("_w"), F.max(height).cast("double").alias("_h"), F.collect_list(g.box()).alias("_regions"))
    pages = pages.where((F.col("_w") > 0) & (F.col("_h") > 0) & F.lit(limit > 0))
    tall = F.col("_h") > F.col("_w") * 1.15
    shaped = pages.withColumns({"_rows": F.when(tall, 3).otherwise(2), "_columns": F.when(tall, 1).otherwise(2)})
    cells = shaped.withColumn("_row", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).withColumn("_column", F.explode(F.sequence(F.lit(0), F.col("_columns") - 1)))
    tw, th, r, c = F.col("_w") / F.col("_columns"), F.col("_h") / F.col("_rows"), F.col("_row"), F.col("_column")
    part = lambda test: F.when(test, F.lit(OVERLAP)).otherwise(F.lit(0.0))
    raw = g.make_box(
        c * tw - F.when(c > 0, tw * OVERLAP).otherwise(F.lit(0.0)),
        r * th - F.when(r > 0, th * OVERLAP).otherwise(F.lit(0.0)),
        tw * (1 + part(c > 0) + part(c < F.col("_columns") - 1)),
        th * (1 + part(r > 0) + part(r < F.col("_rows") - 1)),
    )
    tiled = cells.withColumn("tile", g.clip(raw, F.col("_w"), F.col("_h")))
    covered = F.aggregate("_regions", F.lit(0.0), lambda s, b: s + g.intersection(F.col("tile"), b))
    scored = tiled.withColumn("coverage", covered).where("coverage > 0").withColumn("tile_id", F.concat_ws("-", r.cast("string"), c.cast("string")))
    order = Window.partitionBy(page).orderBy(F.round("coverage", 6).desc(), "tile_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(page, "tile_id", "tile.*", "coverage", "rank")


def line_windows(b: Column, width: Column, height: Column, aspect: float = 8.0, overlap: float = 0.2, most: int = 4) -> Column:
    """Overlapping windows along a long line: array of (x, y, width, height, index), clipped to the image.

    A line of a lower aspect is one window, itself.
    """
    overlap, most = min(0.75, max(0.0, overlap)), max(2, int(most))
    vertical = b["height"] > b["width"]
    long_, short = F.when(vertical, b["height"]).otherwise(b["width"]), F.greatest(F.lit(1.0), F.when(vertical, b["width"]).otherwise(b["height"]))
    count = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(long_ / (short * 4)).cast("int")))
    size = long_ / (count - (count - 1) * F.lit(overlap))

    def window(i: Column) -> Column:
        at = F.least(long_ - size, i * size * F.lit(1 - overlap))
        x, y = F.when(vertical, b["x"]).otherwise(b["x"] + at), F.when(vertical, b["y"] + at).otherwise(b["y"])
        w, h = F.when(vertical, b["width"]).otherwise(size), F.when(vertical, size).otherwise(b["height"])
        x1, y1 = g.clamp(x, 0, width), g.clamp(y, 0, height)
        x2, y2 = F.least(width, F.greatest(x1, x + w)), F.least(height, F.greatest(y1, y + h))
        return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"), i.alias("index"))

    whole = F.array(F.struct(b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"), b["height"].alias("height"), F.lit(0).alias("index")))
    return F.when(long_ / short < aspect, whole).otherwise(F.transform(F.sequence(F.lit(0), count - 1), window))


def ink_gap(projection: Column, transverse: Column, min_gap: float = 0.65, min_segment: float = 2.2, short_share: float = 0.55, active: float = 0.08) -> Column:
    """The longest blank run inside a line's ink projection that separates two pieces: struct start, end; null if none.

    The run must be at least max(8, ceil(min_gap * size)) long with max(12, ceil(min_segment * size)) samples on each side,
    and the shorter side at most ``short_share`` of the longer. Ties go to the earliest run.
    """
    n = F.size(projection)
    gap = F.greatest(F.lit(8), F.ceil(transverse * min_gap).cast("int"))
    side = F.greatest(F.lit(12), F.ceil(transverse * min_segment).cast("int"))
    # ends of runs: positions of active samples; a blank run lies between two neighbours in this list
    marks = F.filter(F.transform(projection, lambda v, i: F.when(v >= active, i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), marks, F.array(n))
    runs = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda k: F.struct((F.get(edges, k) + 1).alias("start"), F.get(edges, k + 1).alias("end")))
    fits = F.filter(
        runs,
        lambda r: (r["end"] - r["start"] >= gap) & (r["start"] >= side) & (n - r["end"] >= side) & (F.least(r["start"], n - r["end"]) <= F.greatest(r["start"], n - r["end"]) * F.lit(short_share)),
    )
    best = F.get(F.array_sort(F.transform(fits, lambda r: F.struct((r["start"] - r["end"]).alias("k"), r["start"].alias("start"), r["end"].alias("end")))), F.lit(0))
    return F.when((n >= 3) & (transverse > 0) & best.isNotNull(), F.struct(best["start"].alias("start"), best["end"].alias("end")))


def split_at_gap(b: Column, gap: Column, step: Column, least: float = 2.2) -> Column:
    """A box cut at an ink gap (in samples of ``step`` pixels): array of one or two boxes."""
    vertical = b["height"] >= b["width"]
    long_, short = F.when(vertical, b["height"]).otherwise(b["width"]), F.greatest(F.lit(1.0), F.when(vertical, b["width"]).otherwise(b["height"]))
    first, second = gap["start"] * step, F.least(long_, gap["end"] * step)
    good = gap.isNotNull() & (long_ / short >= 8) & (first >= short * least) & (long_ - second >= short * least)
    a = F.when(vertical, g.make_box(b["x"], b["y"], b["width"], first)).otherwise(g.make_box(b["x"], b["y"], first, b["height"]))
    c = F.when(vertical, g.make_box(b["x"], b["y"] + second, b["width"], long_ - second)).otherwise(g.make_box(b["x"] + second, b["y"], long_ - second, b["height"]))
    return F.when(good, F.array(a, c)).otherwise(F.array(b))


def split_detections(boxes: DataFrame, ink: DataFrame, page: str = "page_id") -> DataFrame:
    """All boxes, those with a gap in their ink cut in two and numbered anew in order: the columns of ``boxes``.

    ``ink``: page, det_idx, projection (ink share of each sample along the line), step (pixels per sample). Boxes without
    a projection stay whole.
    """
    b = g.box()
    across = F.greatest(F.lit(1.0), F.least(F.col("width"), F.col("height")).cast("double")) / F.col("step")
    told = boxes.join(ink.select(page, "det_idx", "projection", "step"), [page, "det_idx"], "left")
    parts = F.when(F.col("projection").isNull(), F.array(b)).otherwise(split_at_gap(b, ink_gap(F.col("projection"), across), F.col("step")))
    cut = told.select(*[c for c in boxes.columns if c not in ("x", "y", "width", "height")], F.posexplode(parts).alias("part", "b"))
    order = Window.partitionBy(page).orderBy("det_idx", "part")
    numbered = cut.withColumns({"number": (F.row_number().over(order) - 1).cast("long"), **{c: F.col(f"b.{c}") for c in ("x", "y", "width", "height")}})
    return numbered.select(*[F.col("number").alias(c) if c == "det_idx" else F.col(c) for c in boxes.columns])
