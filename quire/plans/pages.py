"""From detections to ordered lines, and benchmark runs over ground truth: the operators composed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import crops, detect, evaluate, order, retry, tiles
from quire.operators.recognise import select_candidates
from quire.plans.config import RETRY, Options
from quire.sources import records


def recognise(
    boxes: DataFrame, make_scorer: Callable[[], retry.Scorer], options: Options, page: str = "page_id", angle=None,
    detect_tiles: Callable[[DataFrame], DataFrame] | None = None, paper: DataFrame | None = None, ink: DataFrame | None = None,
) -> DataFrame:
    """Suppress, merge, recognise with retries, select and order: one row per line.

    ``detect_tiles`` gives the detections of tiles (see :func:`with_tiles`), which ``options.adaptive_tiling`` needs;
    ``paper`` the paper regions (page, box, confidence), which ``options.paper_filter`` needs; an option whose input is
    missing raises. ``ink``: projections of boxes, at whose gaps lines are split (see ``tiles.split_detections``; its
    ``det_idx`` is that of the merged lines).

    Columns: page, det_idx, box, score, the selected candidate, uncertain, reason, n_alternatives, reading_order.
    ``boxes`` also has the image size of its page (image_width, image_height).
    """
    if options.adaptive_tiling and detect_tiles is None:
        raise ValueError("adaptive tiling needs detect_tiles; switch it off otherwise")
    if options.paper_filter != "off" and paper is None:
        raise ValueError("the paper filter needs paper regions; switch it off otherwise")
    sizes = boxes.groupBy(page).agg(F.max("image_width").cast("double").alias("image_width"), F.max("image_height").cast("double").alias("image_height"))
    kept = detect.global_nms(boxes, page)
    merged = detect.merge_adjacent(kept.withColumn("det_idx", F.col("rank").cast("long")), page, options.writing_mode)
    if options.adaptive_tiling:
        on_page = merged.withColumnRenamed("merged_idx", "det_idx")
        wide = on_page.join(sizes.select(page, F.col("image_width").alias("page_width"), F.col("image_height").alias("page_height")), page)
        cut = tiles.adaptive_tiles(wide, options.profile, page).join(wide.select(page, "page_width", "page_height").distinct(), page)
        merged = with_tiles(on_page, detect_tiles(cut), cut, options, page)
    if ink is not None:
        merged = tiles.split_detections(merged.withColumnRenamed("merged_idx", "det_idx"), ink, page).withColumnRenamed("det_idx", "merged_idx")
    if options.paper_filter != "off":
        merged = detect.paper_score(merged.drop("paper_score"), paper, page)
    # read by the clearance join and by the result: kept, so that merging runs once
    lines = merged.withColumnRenamed("merged_idx", "det_idx").persist()
    near = crops.transverse_clearance(lines, page).join(sizes, page)
    padded = crops.expand_in(g.box(), F.col("before"), F.col("after"), F.col("image_width"), F.col("image_height"))
    prepared = near.withColumn("p", padded).select(page, "det_idx", "x", "y", "width", "height", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("x", "y", "width", "height")], F.lit(True).alias("has_crops"))
    found = retry.recognise_pages(prepared, make_scorer, options, page, angle)
    chosen = select_candidates(found, page, "det_idx")
    fields = ("text", "recognition_score", "minimum_token_score", "mean_token_margin", "eos_score", "ended_with_eos", "source", "preprocessing", "orientation", "deskew_angle")
    out = lines.join(chosen, [page, "det_idx"]).select(
        page, "det_idx", "x", "y", "width", "height", "score", *[F.col(f"selected.{c}").alias(c) for c in fields], "uncertain", "reason", F.size("alternatives").alias("n_alternatives")
    )
    if options.paper_filter != "off":
        trust = paper.groupBy(page).agg(F.max("confidence").alias("confidence"))
        scored = out.join(lines.select(page, "det_idx", "paper_score"), [page, "det_idx"]).join(trust, page, "left")
        dropped = detect.suppressed_by_paper(F.coalesce("confidence", F.lit(0.0)), F.col("paper_score"), F.col("text"), F.col("recognition_score"))
        out = scored.where(~F.coalesce(dropped, F.lit(False))).drop("confidence")
    return order.reading_order(out, page, options.writing_mode, options.scattered)


def with_tiles(boxes: DataFrame, local: DataFrame, tiles: DataFrame, options: Options, page: str = "page_id") -> DataFrame:
    """Detections of whole pages and of their tiles together: restored to page coordinates, suppressed and merged again.

    ``local``: page, tile_id, det_idx, box in tile coordinates, score. ``tiles``: page, tile_id, box, page_width,
    page_height. Page detections come first where scores are equal, then those of the tiles in order of their id.
    """
    t = tiles.select(page, "tile_id", g.box().alias("t"), F.col("page_width").cast("double").alias("pw"), F.col("page_height").cast("double").alias("ph"))
    moved = local.join(t, [page, "tile_id"]).select(page, "tile_id", "det_idx", g.restore(F.col("t"), g.box(), F.col("pw"), F.col("ph")).alias("b"), "score")
    own = boxes.select(page, F.lit("").alias("tile_id"), "det_idx", g.box().alias("b"), "score")
    every = evaluate.indexed(own.unionByName(moved), page, "place", "tile_id", "det_idx").select(page, F.col("place").cast("long").alias("det_idx"), "b.*", "score")
    kept = detect.global_nms(every, page)
    return detect.merge_adjacent(kept.withColumn("det_idx", F.col("rank").cast("long")), page, options.writing_mode)


def apply_result(lines: DataFrame, pages: DataFrame, page: str = "page_id") -> DataFrame:
    """Lines in page coordinates: boxes scaled from image to page size (the image's where the page has none).

    ``pages``: page, width, height of the page, image_width, image_height. Lines of other pages are dropped.
    """
    size = lambda own, image: F.when(F.coalesce(F.col(own), F.lit(0.0)) != 0, F.col(own)).otherwise(F.col(image))
    scale = pages.select(page, (size("width", "image_width") / F.greatest(F.lit(1.0), F.col("image_width"))).alias("_sx"), (size("height", "image_height") / F.greatest(F.lit(1.0), F.col("image_height"))).alias("_sy"))
    joined = lines.join(scale, page)
    return joined.withColumns({"x": F.col("x") * F.col("_sx"), "y": F.col("y") * F.col("_sy"), "width": F.col("width") * F.col("_sx"), "height": F.col("height") * F.col("_sy")}).drop("_sx", "_sy")


def benchmark(lines: DataFrame, truth: DataFrame, options: Options, page: str = "page_id", normalize=None) -> DataFrame:
    """Metrics of recognised lines (det_idx becomes pred_idx) against ground truth, at the profile's threshold."""
    return evaluate.page_metrics(lines.withColumnRenamed("det_idx", "pred_idx"), truth, page, threshold=RETRY[options.profile], normalize=normalize)


def run_dataset(pages: DataFrame, lines: DataFrame, truth: DataFrame | None, options: Options, normalize=None, engine: str | None = None) -> DataFrame:
    """Benchmark records of a whole data set, one per page: recognised lines, their metrics against ground truth (null for a
    page without any), options and statistics. ``pages``: canvasId and what :func:`quire.sources.records.record` names.

    ``lines``: canvasId, detectionIndex, box, text and scores. ``truth``: canvasId, ref_idx, text, box.
    """
    metrics = None
    if truth is not None:
        names = {"detectionIndex": "pred_idx", "recognitionScore": "recognition_score", "endedWithEos": "ended_with_eos", "readingOrder": "reading_order"}
        pred = lines.withColumnsRenamed(names)
        measured = evaluate.page_metrics(pred, truth, "canvasId", threshold=RETRY[options.profile], normalize=normalize)
        metrics = measured.join(truth.select("canvasId").distinct(), "canvasId", "left_semi")
    region = F.struct("x", "y", "width", "height").alias("region")
    rest = [c for c in lines.columns if c not in ("x", "y", "width", "height")]
    return records.record(pages, lines.select(*rest, region), options, metrics, engine=engine)


def run_stats(candidates: DataFrame, page: str = "page_id", cut: DataFrame | None = None, requests: DataFrame | None = None, seconds: float = 0.0) -> DataFrame:
    """Counters of a run per page.

    ``candidates``: of :func:`quire.operators.retry.recognise_pages`. ``cut``: the tiles that were detected (page, tile_id,
    width, height). ``requests``: crops that were fetched beyond the page (page, failed). The page itself and each tile
    take one inference of the detector, each candidate one of the recogniser; ``max_canvas_pixels`` is the largest tile
    (null without tiles).
    """
    first = F.count_if(F.col("ord") == 0) if "ord" in candidates.columns else F.count_distinct("det_idx")
    out = candidates.groupBy(page).agg(
        F.count_distinct("det_idx").alias("detection_count"), F.count("*").alias("candidate_count"), F.max("extra").alias("extra_attempts"),
        F.count_if(F.col("preprocessing") == "high-resolution-original").alias("high_resolution_retries"), F.count_if(F.col("source") == "segmented").alias("segmented_lines"),
        first.alias("initial_recognitions"), (F.count("*") - first).alias("extra_recognitions"),
    )
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    shown = ["adaptive_tiles", "additional_crop_requests", "additional_crop_failures"]
    if cut is not None:
        out = out.join(cut.groupBy(page).agg(F.count("*").alias(shown[0]), F.max(F.col("width") * F.col("height")).alias("max_canvas_pixels")), page, "left")
    else:
        out = out.withColumns({shown[0]: F.lit(0).cast("long"), "max_canvas_pixels": F.lit(None).cast("double")})
    if requests is not None:
        out = out.join(requests.groupBy(page).agg(F.count("*").alias(shown[1]), F.count_if(F.col("failed")).alias(shown[2])), page, "left")
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in shown[1:]})
    out = out.select(page, *[c for c in out.columns if c not in (page, *shown)], *[whole(c) for c in shown])
    return out.withColumns({"model_inference_count": 1 + F.col("adaptive_tiles") + F.col("candidate_count"), "duration_ms": F.lit(round(seconds * 1000))})
