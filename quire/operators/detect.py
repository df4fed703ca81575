"""Detected boxes: filtering, suppression and merging, per page.

Tables have a row per box: the page key, ``det_idx`` (order within the page), x, y, width, height and ``score``.
Suppression and merging fold over one page's boxes in order; a page is one row's array then, so the whole table needs a
single exchange by page key, which later per-page steps reuse. Suppression and merging loop in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quire.functions import geometry as g

IOU, SMALLER = 0.5, 0.9
GAP_RATIO, TRANSVERSE = 1.2, 0.65


def filter_detections(raw: DataFrame, threshold: float, padded: float, image_width: float, image_height: float, detector: float = 1024.0) -> DataFrame:
    """Boxes x1, y1, x2, y2, score in detector coordinates -> boxes in image coordinates.

    Keeps finite scores over the threshold, positive sizes and centres inside the image; pads the height by 2 % (1 at
    least), clips, and drops boxes under 4 pixels or with less than 65 % of their area left.
    """
    scale = padded / detector
    x1, y1, x2, y2 = (F.col(c).cast("double") * scale for c in ("x1", "y1", "x2", "y2"))
    score, width, height = F.col("score").cast("double"), F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    cx, cy = F.col("_x1") + width / 2, F.col("_y1") + height / 2
    pad = F.greatest(F.lit(1.0), height * 0.02)
    out = (
        raw.where(score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")) & (score > threshold))
        .withColumns({"_x1": x1, "_y1": y1, "_x2": x2, "_y2": y2})
        .where((width > 0) & (height > 0) & (cx >= 0) & (cy >= 0) & (cx < image_width) & (cy < image_height))
        .withColumns({"x": g.clamp(F.col("_x1"), 0, image_width), "y": g.clamp(F.col("_y1") - pad, 0, image_height)})
        .withColumns({
            "width": g.clamp(F.col("_x2"), 0, image_width) - F.col("x"),
            "height": g.clamp(F.col("_y2") + pad, 0, image_height) - F.col("y"),
            "_full": width * (height + pad * 2),
        })
    )
    kept = out.where((F.col("width") >= 4) & (F.col("height") >= 4) & (F.col("width") * F.col("height") / F.col("_full") >= 0.65))
    return kept.drop("_x1", "_y1", "_x2", "_y2", "_full", "x1", "y1", "x2", "y2")


def per_page(boxes: DataFrame, page: str, *order: Column) -> DataFrame:
    """One row per page with ``boxes``, an array of (idx, score, box) in the given order (default: idx)."""
    item = F.struct(*order, F.col("det_idx").alias("idx"), F.col("score").cast("double").alias("score"), g.box().alias("box"))
    return boxes.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("boxes"))


#: Rows of the table of overlaps that are filled at once; the whole table of a dense page would be quadratic in memory.
BLOCK = 64


def kept_boxes(x: np.ndarray, iou: float, smaller: float) -> np.ndarray:
    """Places of the boxes that suppression keeps. ``x``: rows of x, y, width, height of one page, best first."""
    low, high = x[:, :2], x[:, :2] + x[:, 2:4]
    area = np.maximum(0.0, x[:, 2]) * np.maximum(0.0, x[:, 3])
    alive = np.ones(len(x), bool)
    for start in range(0, len(x), BLOCK):
        rows = np.flatnonzero(alive[start : start + BLOCK]) + start
        side = np.maximum(0.0, np.minimum(high[rows, None], high[None, start:]) - np.maximum(low[rows, None], low[None, start:]))
        common = side[..., 0] * side[..., 1]
        union = area[rows, None] + area[None, start:] - common
        least = np.minimum(area[rows, None], area[None, start:])
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = (np.where(union > 0, common / union, 0.0) >= iou) | (np.where(least > 0, common / least, 0.0) >= smaller)
        for k, row in enumerate(rows):
            if alive[row]:
                alive[row + 1 :] &= ~hit[k, row + 1 - start :]
    return np.flatnonzero(alive)


def global_nms(boxes: DataFrame, page: str = "page_id", iou: float = IOU, smaller: float = SMALLER) -> DataFrame:
    """Non-maximum suppression per page: by descending score, a box is kept unless a kept box overlaps it too much.

    Suppressed boxes do not suppress. Both thresholds count as reached when equal; ties go to the lower index; a box with
    an unknown coordinate is kept and suppresses none. Columns: the page, det_idx, x, y, width, height, score, rank (order
    of keeping). Whether a box is kept depends on all before it, so a page is folded in numpy, many pages to a call.
    """

    @arrow_udf(T.ArrayType(T.IntegerType(), False))
    def places(x: pa.Array, y: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        flat = np.column_stack([c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (x, y, width, height)])
        ends = np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))
        kept = [kept_boxes(flat[start:end], iou, smaller) for start, end in zip(np.concatenate(([0], ends)), ends)]
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in kept])))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, int), *kept]), pa.int32()))

    sides = [F.col(f"boxes.box.{c}").cast("array<double>") for c in ("x", "y", "width", "height")]
    pages = per_page(boxes, page, (-F.col("score").cast("double")).alias("key")).withColumn("kept", places(*sides))
    return (
        pages.select(page, F.posexplode(F.transform("kept", lambda k: F.get("boxes", k))).alias("rank", "d"))
        .select(page, F.col("d.idx").cast("long").alias("det_idx"), "d.box.*", "d.score", "rank")
    )


def orientation_votes(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page: orientation by the 1.5 rule (ties vertical) used for merging, and the votes."""
    tall = F.count_if(F.col("height") >= F.col("width") * 1.5)
    wide = F.count_if(F.col("width") >= F.col("height") * 1.5)
    return boxes.groupBy(page).agg(tall.alias("n_vertical"), wide.alias("n_horizontal"), F.when(tall >= wide, "vertical").otherwise("horizontal").alias("orientation"))


def adjacent(a: Column, b: Column, vertical: bool, gap_ratio: float = GAP_RATIO, transverse: float = TRANSVERSE) -> Column:
    """Whether two boxes are pieces of one line: enough transverse overlap and a small longitudinal gap."""
    t, along = ("x", "y") if vertical else ("y", "x")
    size_a, size_b = a[g.AXES[t]], b[g.AXES[t]]
    least = F.least(size_a, size_b)
    gap = F.greatest(F.lit(0.0), F.greatest(a[along], b[along]) - F.least(g.end(a, along), g.end(b, along)))
    return (least > 0) & (F.when(least > 0, g.overlap_along(a, b, t) / least) >= transverse) & (gap <= F.greatest(size_a, size_b) * gap_ratio)


def merge_page(x: np.ndarray, orientation: str = "auto", gap_ratio: float = GAP_RATIO, transverse: float = TRANSVERSE) -> np.ndarray:
    """Merge adjacent boxes of one page. ``x``: rows of x, y, width, height, score, paper score (NaN: none), in order."""
    if len(x) < 2:
        return x
    if orientation not in ("vertical", "horizontal"):
        orientation = "vertical" if (x[:, 3] >= x[:, 2] * 1.5).sum() >= (x[:, 2] >= x[:, 3] * 1.5).sum() else "horizontal"
    t, along = (0, 1) if orientation == "vertical" else (1, 0)
    queue = x[np.lexsort((x[:, t], x[:, along]))]
    open_ = np.empty((0, x.shape[1]))
    for box in queue:
        while len(open_):
            size = np.minimum(open_[:, t + 2], box[t + 2])
            common = np.minimum(open_[:, t] + open_[:, t + 2], box[t] + box[t + 2]) - np.maximum(open_[:, t], box[t])
            gap = np.maximum(open_[:, along], box[along]) - np.minimum(open_[:, along] + open_[:, along + 2], box[along] + box[along + 2])
            with np.errstate(divide="ignore", invalid="ignore"):
                near = (size > 0) & (np.maximum(common, 0) / size >= transverse) & (np.maximum(gap, 0) <= np.maximum(open_[:, t + 2], box[t + 2]) * gap_ratio)
            if not near.any():
                break
            k = int(np.argmax(near))
            other, open_ = open_[k], np.delete(open_, k, axis=0)
            low = np.minimum(other[:2], box[:2])
            high = np.maximum(other[:2] + other[2:4], box[:2] + box[2:4])
            box = np.concatenate((low, high - low, [max(other[4], box[4]), np.fmin(other[5], box[5])]))
        open_ = np.vstack((open_, box))
    return open_


def merge_adjacent(boxes: DataFrame, page: str = "page_id", orientation: str = "auto") -> DataFrame:
    """Merge pieces of lines per page, until no two are adjacent: the page, merged_idx, x, y, width, height, score, paper_score.

    The fixpoint inside each step needs a loop, so a page is one Arrow group.
    """
    key = boxes.schema[page].dataType.simpleString()
    paper = F.col("paper_score").cast("double") if "paper_score" in boxes.columns else F.lit(None).cast("double")
    flat = boxes.select(page, F.col("det_idx").cast("long").alias("det_idx"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height", "score")], paper.alias("paper_score"))
    names = ["x", "y", "width", "height", "score", "paper_score"]

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("det_idx")
        rows = np.column_stack([table.column(c).to_numpy().astype(float) for c in names])
        out = merge_page(rows, orientation)
        owner = pa.concat_arrays([table.column(page).combine_chunks().slice(0, 1)] * len(out)) if not isinstance(table.column(page).combine_chunks(), pa.ChunkedArray) else pa.array([table.column(page)[0].as_py()] * len(out), table.column(page).type)
        paper_ = pa.array(out[:, 5], mask=np.isnan(out[:, 5]))
        return pa.table([owner, pa.array(np.arange(len(out))), *[pa.array(out[:, k]) for k in range(5)], paper_], names=[page, "merged_idx", *names])

    return flat.groupBy(page).applyInArrow(merge, f"{page} {key}, merged_idx long, x double, y double, width double, height double, score double, paper_score double")


def overlaps(boxes: DataFrame, page: str = "page_id", measure=g.iou, least: float = 0.1) -> DataFrame:
    """Pairs of boxes of one page whose overlap reaches ``least``: the page, a_idx, b_idx, overlap."""
    a = boxes.select(page, F.col("det_idx").alias("a_idx"), g.box().alias("a"))
    b = boxes.select(page, F.col("det_idx").alias("b_idx"), g.box().alias("b"))
    pairs = a.join(b, page).where(F.col("a_idx") < F.col("b_idx"))
    return pairs.withColumn("overlap", measure(F.col("a"), F.col("b"))).where(F.col("overlap") >= least).drop("a", "b")


def paper_score(boxes: DataFrame, paper: DataFrame, page: str = "page_id") -> DataFrame:
    """Largest share of each box that one paper region covers (``paper``: page, x, y, width, height, confidence).

    No paper or no confidence: 0.5; a box without area: 0.
    """
    regions = paper.groupBy(page).agg(F.collect_list(g.box()).alias("_paper"), F.max("confidence").alias("_confidence"))
    b = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    shares = F.array_max(F.transform("_paper", lambda p: g.intersection(F.col("_box"), p)))
    size = g.area(F.col("_box"))
    score = F.when(F.col("_paper").isNull() | (F.coalesce("_confidence", F.lit(0.0)) == 0), F.lit(0.5)).when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), shares / F.when(size > 0, size)))
    return boxes.join(regions, page, "left").withColumn("_box", b).withColumn("paper_score", score).drop("_paper", "_confidence", "_box")


def suppressed_by_paper(confidence: Column, score: Column, text: Column, recognition: Column) -> Column:
    """Whether a soft paper filter drops a line: off the paper and either blank or hardly recognised."""
    from quire.functions.text import is_blank

    return (confidence >= 0.35) & (score < 0.08) & (is_blank(text) | F.coalesce(recognition < 0.25, F.lit(False)))


