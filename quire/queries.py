"""One query per operator over the driver tables. Computed doubles are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import geometry as g
from quire.functions import numeric, text
from quire.operators import crops, detect, dictionary, evaluate, order, pixels, recognise, retry, tiles
from quire.plans import pages, views
from quire.plans.config import DETECTION, Options
from quire.sources import cache, manifest, records, truth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(frame: DataFrame) -> DataFrame:
    """Round the double columns of a result."""
    return frame.select(*[(F.round(f"`{f.name}`", 6) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")).alias(f.name) for f in frame.schema])


def longs(frame: DataFrame) -> DataFrame:
    """Whole numbers as longs, as the SQL side has them."""
    return frame.select(*[(F.col(f.name).cast("long") if isinstance(f.dataType, T.IntegerType) else F.col(f.name)).alias(f.name) for f in frame.schema])


def done(frame: DataFrame) -> DataFrame:
    return longs(six(frame))


# --- boxes ---


@query
def box_iou_pairs(spark, d):
    return done(detect.overlaps(views.detections(spark, d), measure=g.iou, least=0.1))


@query
def box_overlap_smaller(spark, d):
    return done(detect.overlaps(views.detections(spark, d), measure=g.overlap_over_smaller, least=0.5))


@query
def detection_filter(spark, d):
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    raw = views.detections(spark, d).select("page_id", "det_idx", (x - 20).alias("x1"), (y - 20).alias("y1"), (x - 20 + w).alias("x2"), (y - 20 + h).alias("y2"), "score")
    return done(detect.filter_detections(raw, DETECTION["balanced"], 2048, 780, 1100))


@query
def global_nms(spark, d):
    return done(detect.global_nms(views.detections(spark, d)))


@query
def merge_adjacent(spark, d):
    return done(detect.merge_adjacent(views.detections(spark, d)))


@query
def orientation_vote(spark, d):
    return done(detect.orientation_votes(views.detections(spark, d)))


@query
def writing_mode_vote(spark, d):
    return done(order.writing_mode(views.detections(spark, d)))


def _stretched() -> Column:
    return g.make_box(F.col("x") * 1.37, F.col("y") * 1.21, F.col("width") * 1.13, F.col("height") * 0.91)


@query
def crop_bounds(spark, d):
    boxes = views.detections(spark, d).select("page_id", "det_idx", g.whole_pixels(_stretched(), F.lit(500.0), F.lit(650.0)).alias("b"))
    return done(boxes.select("page_id", "det_idx", "b.*"))


@query
def crop_clearance(spark, d):
    return done(crops.transverse_clearance(views.detections(spark, d)).select("page_id", "det_idx", "before", "after"))


def _expanded(spark, d) -> DataFrame:
    near = crops.transverse_clearance(views.detections(spark, d))
    return near.withColumn("e", crops.expand_in(g.box(), F.col("before"), F.col("after"), F.lit(440.0), F.lit(640.0)))


@query
def crop_expand(spark, d):
    return done(_expanded(spark, d).select("page_id", "det_idx", "e.*"))


@query
def crop_url(spark, d):
    service = F.concat(F.lit("https://images.example/"), F.col("page_id").cast("string"), F.lit("/"))
    url = crops.line_crop_url(service, F.lit(880.0), F.lit(1600.0), F.lit(440.0), F.lit(640.0), F.col("e"))
    return done(_expanded(spark, d).select("page_id", "det_idx", url.alias("url")))


@query
def percent_crop_url(spark, d):
    region = g.make_box(F.col("x") / 4, F.col("y") / 6, F.col("width") / 4, F.col("height") / 6)
    return views.detections(spark, d).select("page_id", "det_idx", crops.percent_crop_url(F.lit("https://images.example/p"), F.lit(1234.0), F.lit(987.0), region).alias("url"))


def _small(spark, d) -> DataFrame:
    """All boxes at an eighth of their size, so that pages have gaps to cut at."""
    return views.detections(spark, d).withColumns({c: F.col(c) / 8 for c in ("width", "height")})


@query
def layout_blocks(spark, d):
    return done(order.layout_blocks(_small(spark, d)).select("page_id", "det_idx", "block"))


@query
def reading_order(spark, d):
    return done(order.reading_order(views.detections(spark, d)).select("page_id", "det_idx", "reading_order"))


@query
def reading_order_sparse(spark, d):
    return done(order.reading_order(_small(spark, d)).select("page_id", "det_idx", "reading_order"))


@query
def tile_restore(spark, d):
    tile = g.make_box(F.lit(200.0), F.lit(300.0), F.lit(250.0), F.lit(350.0))
    return done(views.detections(spark, d).select("page_id", "det_idx", g.restore(tile, g.box(), F.lit(420.0), F.lit(640.0)).alias("b")).select("page_id", "det_idx", "b.*"))


@query
def line_windows(spark, d):
    long_box = g.make_box(F.col("x"), F.col("y"), F.col("width") * 8, F.col("height") / 2)
    rows = views.detections(spark, d).select("page_id", "det_idx", F.explode(tiles.line_windows(long_box, F.lit(640.0), F.lit(600.0))).alias("w"))
    return done(rows.select("page_id", "det_idx", "w.*"))


def _projections(spark, d) -> DataFrame:
    start = 14 + F.col("vec_id") % 20
    values = F.transform("embedding", lambda e, i: F.when((i >= start) & (i <= start + 8 + F.col("label")), F.lit(0.0)).otherwise(F.abs(e).cast("double") + 0.08))
    return views.table(spark, d, "embeddings").withColumn("projection", values)


@query
def ink_gap(spark, d):
    return done(_projections(spark, d).withColumn("g", tiles.ink_gap(F.col("projection"), F.lit(5.0))).where("g is not null").select("vec_id", "g.start", "g.end"))


# --- recognition ---


@query
def log_softmax(spark, d):
    rows = views.table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("position"), "embedding")
    scores = rows.select("vec_id", "position", F.posexplode(numeric.log_softmax(F.slice("embedding", F.col("position") * 8 + 1, F.lit(8)))).alias("class", "log_p"))
    return done(scores)


@query
def decode_scores(spark, d):
    charset = F.array(*[F.lit(c) for c in "ABCDEFG"])
    # sharpened, so that some rows end early and probabilities differ
    logits = F.transform("embedding", lambda e: e.cast("double") * 20)
    decoded = views.table(spark, d, "embeddings").select("vec_id", recognise.decode(logits, 8, 8, charset).alias("r"))
    fields = ("text", "recognition_score", "minimum_token_score", "mean_token_margin", "eos_score", "ended_with_eos")
    return done(decoded.select("vec_id", *[f"r.{c}" for c in fields]))


# --- text ---


@query
def line_search(spark, d):
    lines = views.table(spark, d, "conversations").select("conv_id", "turn", text.trim(F.col("text")).alias("line"))
    return done(lines.where(F.contains("line", F.lit("tion"))).select("conv_id", "turn", (F.instr("line", F.lit("tion")) - 1).alias("position"), F.length("line").alias("n_chars")))


@query
def empty_rate(spark, d):
    lines = views.table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 5 == 4, F.lit(" \t　")).otherwise(F.col("text")).alias("text"))
    return done(evaluate.empty_rate(lines, "conv_id"))


# A small dictionary with a chain (a -> b -> c) and a wide variant.
DICTIONARY = [(0, "e", ["é", "è", "ê"]), (1, "a", ["à", "ä"]), (2, "sch", ["tion"]), (3, "o", ["ó", "ö"]), (4, "ñ", ["n"]), (5, "u", ["ü", "ú"]), (6, "q", ["x"]), (7, "k", ["q"])]


def entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "entry_idx int, normalized string, variants array<string>")


@query
def dict_normalize(spark, d):
    ordered = dictionary.resolve(entries(spark))
    return views.table(spark, d, "documents").select("doc_id", dictionary.normalize(F.col("text"), ordered).alias("text"))


@query
def dict_search(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    found = dictionary.search(docs, entries(spark), "doc_id")
    return done(found.select("doc_id", "entry_idx", "position"))


# --- evaluation ---


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    boxes = views.detections(spark, d)
    return views.predictions(boxes), views.truths(boxes)


@query
def region_match(spark, d):
    return done(evaluate.match_regions(*_sides(spark, d)))


@query
def detection_prf(spark, d):
    return done(evaluate.detection_prf(*_sides(spark, d)))


@query
def unmatched_pred(spark, d):
    pred, truth = _sides(spark, d)
    return evaluate.unmatched_predictions(pred, evaluate.match_regions(pred, truth)).select("page_id", "pred_idx")


@query
def missed_truth(spark, d):
    pred, truth = _sides(spark, d)
    return evaluate.missed_truths(truth, evaluate.match_regions(pred, truth)).select("page_id", "ref_idx")


@query
def order_accuracy(spark, d):
    pred, truth = _sides(spark, d)
    return done(evaluate.order_accuracy(pred, evaluate.match_regions(pred, truth)))


@query
def page_metrics(spark, d):
    return done(evaluate.page_metrics(*_sides(spark, d)))


@query
def screen_averages(spark, d):
    lines = views.detections(spark, d).select("page_id", F.when(F.col("det_idx") % 4 != 0, F.col("score")).alias("recognition_score"), (F.col("score") / 2).alias("detection_score"))
    return done(evaluate.screen_averages(lines))


# --- records, cache, statistics ---


@query
def json_props(spark, d):
    events = views.table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "struct<k:int>", {"mode": "PERMISSIVE"}).alias("p"))
    valid = F.coalesce(F.col("p.k") >= 0, F.lit(False))
    return done(events.select("event_id", "event_type", F.col("p.k").alias("k"), valid.alias("valid")))


def _runs(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    metrics = F.struct(*[((F.col("o_totalprice") * (i + 1)) % 1000 / 1000).alias(c) for i, c in enumerate(records.METRICS)])
    first = orders.where(k % 3 != 1).select(k.alias("canvas_id"), F.col("o_custkey").alias("payload"), F.when(k % 7 != 0, metrics).alias("metrics"))
    second = orders.where(k % 3 != 2).select(k.alias("canvas_id"), (F.col("o_custkey") + (k % 5 == 0).cast("int")).alias("payload"), F.when(k % 11 != 0, metrics).alias("metrics"))
    changed = second.withColumn("metrics", F.when(F.col("metrics").isNotNull(), F.struct(*[((F.col("canvas_id") + i) % 50 / 50).alias(c) for i, c in enumerate(records.METRICS)])))
    return first, changed


@query
def run_determinism(spark, d):
    first, second = _runs(spark, d)
    return done(records.differing(first, second, F.col("payload")))


@query
def baseline_delta(spark, d):
    return done(records.baseline_deltas(*_runs(spark, d)))


@query
def cache_latest(spark, d):
    events = views.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return done(cache.latest(events, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value"))


@query
def upper_median(spark, d):
    values = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return done(values.select("l_orderkey", numeric.upper_median(F.col("v")).alias("median")))


@query
def floor_percentile(spark, d):
    values = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("v"))
    return done(values.select("l_orderkey", *[numeric.floor_percentile(F.col("v"), p).alias(f"p{int(p * 100)}") for p in (0.05, 0.82, 0.95)]))


# --- sources, kernels and whole pages ---


def _manifests(spark, d) -> DataFrame:
    """A manifest per customer with a canvas per order."""
    k = F.col("o_orderkey").cast("string")
    body = F.struct(F.concat(F.lit("https://i.example/"), k).alias("id"), F.array(F.struct(F.concat(F.lit("https://s.example/"), k, F.lit("/")).alias("id"))).alias("service"))
    inner = F.array(F.struct(F.array(F.struct(F.when(F.col("o_orderkey") % 6 != 0, body).alias("body"))).alias("items")))
    canvas = F.struct(
        F.col("o_orderkey").alias("o"), F.concat(F.lit("canvas/"), k).alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.struct(F.array(F.concat(F.lit("page "), k)).alias("en"))).alias("label"),
        (F.col("o_orderkey") % 1000).alias("width"), inner.alias("items"),
    )
    grouped = views.table(spark, d, "orders").select("o_custkey", canvas.alias("c")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("c")).alias("items"))
    url = F.concat(F.lit("https://m.example/biblio/"), F.col("o_custkey").cast("string"), F.lit("/manifest"))
    return grouped.select(url.alias("source_url"), F.to_json(F.struct(url.alias("id"), "items")).alias("raw"))


@query
def manifest_pages(spark, d):
    _, rows = manifest.parse_manifests(_manifests(spark, d))
    return done(rows.select("source_url", "canvas_index", "canvas_id", "image_service_id", "label", "image", "width"))


@query
def manifests(spark, d):
    rows, _ = manifest.parse_manifests(_manifests(spark, d))
    return done(rows.select("source_url", "url", "title", "attribution", "record_id", "n_pages", "viewing_direction", "error"))


@query
def ground_truth_lines(spark, d):
    t = views.truths(views.detections(spark, d))
    line = F.struct("ref_idx", F.when(F.col("ref_idx") != F.col("page_id") % 60, F.col("text")).alias("text"), F.struct("x", "y", "width", "height").alias("region"))
    page = F.col("page_id").cast("string")
    docs = t.select("page_id", line.alias("l")).groupBy("page_id").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    raw = docs.select(F.to_json(F.struct(page.alias("id"), F.lit("m").alias("manifestUrl"), page.alias("canvasId"), "lines")).alias("raw"))
    good, _ = truth.parse_truth(raw)
    return done(truth.truth_lines(good).select("canvas_id", "ref_idx", "text", "x", "y", "width", "height"))


@query
def nfkc(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.nfkc("text").alias("text"))


@query
def csv_lines(spark, d):
    rows = views.predictions(views.detections(spark, d)).select(
        F.col("page_id").cast("string").alias("canvasId"), F.col("pred_idx").alias("lineIndex"), F.concat(F.lit('a "q", '), "text").alias("text"), F.col("ended_with_eos").alias("endedWithEos")
    )
    return rows.select("canvasId", "lineIndex", records.csv_row(rows).alias("line"))


@query
def benchmark_records(spark, d):
    """A record per page of a run, with options, counts and metrics; every third page has no ground truth."""
    boxes = views.detections(spark, d)
    pred, wanted = views.predictions(boxes), views.truths(boxes)
    names = {"page_id": "canvasId", "pred_idx": "detectionIndex", "recognition_score": "recognitionScore", "ended_with_eos": "endedWithEos", "reading_order": "readingOrder"}
    lines = pred.withColumnsRenamed({k: v for k, v in names.items() if k in pred.columns})
    found = boxes.select(F.col("page_id").alias("canvasId")).distinct().withColumns({"width": F.lit(440.0), "height": F.lit(700.0), "imageWidth": F.when(F.col("canvasId") % 2 == 0, 880.0)})
    out = pages.run_dataset(found, lines, wanted.where("page_id % 3 <> 0").withColumnRenamed("page_id", "canvasId"), Options.of(profile="balanced"), engine="test")
    flat = out.select(
        F.col("canvasId").alias("page_id"), "schemaVersion", "modelRevision", F.col("execution.browser").alias("browser"), F.col("execution.profile").alias("profile"), F.col("output.imageWidth").alias("image_width"),
        F.size("output.lines").alias("n_lines"), F.col("metrics.predicted").alias("predicted"), F.col("metrics.reference").alias("reference"), F.col("metrics.cer").alias("cer"),
        F.col("metrics.order_accuracy").alias("order_accuracy"), F.col("metrics.empty_rate").alias("empty_rate"),
    )
    return done(flat)


@query
def csv_numbers(spark, d):
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("canvasId"), F.col("l_linenumber").alias("lineIndex"), F.col("l_quantity").cast("double").alias("detectionScore"), (F.col("l_linenumber") / 8).alias("recognitionScore"))
    return done(rows.select("canvasId", "lineIndex", records.csv_row(rows).alias("line")))


@query
def image_kernels(spark, d):
    """Embeddings as 8 x 8 images: paper share, ink regions and deskew rank of each."""
    images = views.table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", lambda e: (e.cast("double") + 0.5) * 255).alias("pixels"))

    def kernel(gray):
        regions, share = pixels.paper_mask(gray)
        return {"paper": round(share, 6), "n_paper": len(regions), "n_ink": len(pixels.uncovered_ink(gray, [])), "angle": pixels.rank_deskew_angles(gray)[0]}

    out = pixels.map_images(images, kernel, "struct<paper:double,n_paper:bigint,n_ink:bigint,angle:double>", "r")
    return out.select("vec_id", "r.*")


@query
def page_recognition(spark, d):
    """Detections to ordered lines with a scorer that stands in for a model."""

    def make_scorer():
        def score(a):
            doubt = 0.3 if a.det_idx % 3 == 0 and a.preprocessing == "original" else 0.9
            return retry.Decoded(f"line {a.det_idx}", doubt, doubt, 2.0, True, 0.9)

        return score

    boxes = views.detections(spark, d).withColumns({"image_width": F.lit(440.0), "image_height": F.lit(700.0)})
    lines = pages.recognise(boxes, make_scorer, Options.of(profile="balanced"))
    return done(lines.select("page_id", "det_idx", "text", "recognition_score", "reason", "uncertain", "n_alternatives", "reading_order"))


# --- whole texts, and competing readings of every whole line ---

LINE = ("doc_id", "line_idx")


@query
def edit_distance(spark, d):
    return done(views.text_pairs(spark, d).select("doc_id", text.text_distance(F.col("a"), F.col("b")).alias("distance")))


@query
def edit_distance_norm(spark, d):
    return done(views.text_pairs(spark, d).select("doc_id", text.normalized_distance(F.col("a"), F.col("b"), text.text_distance).alias("distance")))


@query
def cer(spark, d):
    return done(views.text_pairs(spark, d).select("doc_id", text.cer(F.col("a"), F.col("b"), text.text_distance).alias("cer")))


@query
def segment_merge(spark, d):
    third = F.floor(F.length("t") / 3).cast("int")
    pieces = F.array(F.substring(F.col("t"), F.lit(1), third + 5), F.substring(F.col("t"), third + 1, third + 5), F.substring(F.col("t"), 2 * third + 1, F.length("t")))
    return done(views.spread(views.texts(spark, d), "doc_id").select("doc_id", text.merge_pieces(pieces).alias("merged")))


@query
def cache_key_hash(spark, d):
    return views.texts(spark, d).select("doc_id", text.fnv1a(F.col("t")).alias("hash"))


@query
def low_confidence(spark, d):
    c = views.candidates(spark, d)
    return done(c.select(*LINE, "ord", recognise.low_confidence(recognise.candidate(c), g.make_box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")), "balanced").alias("low")))


@query
def candidate_utility(spark, d):
    c = views.candidates(spark, d)
    return done(c.select(*LINE, "ord", recognise.utility(recognise.candidate(c)).alias("utility")))


@query
def candidate_top_score(spark, d):
    return done(recognise.top_score(views.candidates(spark, d), *LINE).select(*LINE, "selected.ord", "selected.text"))


@query
def candidate_consensus(spark, d):
    chosen = recognise.select_candidates(views.candidates(spark, d), *LINE)
    return done(chosen.select(*LINE, "selected.ord", "selected.text", F.size("alternatives").alias("n_alternatives"), "uncertain", "reason"))


@query
def strategy_compare(spark, d):
    return done(recognise.compare_strategies(views.candidates(spark, d), *LINE))


@query
def tiles_topk(spark, d):
    width = F.when(F.col("page_id") % 2 == 0, 420.0).otherwise(900.0)
    return done(tiles.adaptive_tiles(views.detections(spark, d).withColumns({"page_width": width, "page_height": F.lit(640.0)}), "balanced"))


@query
def paper_score(spark, d):
    boxes = views.detections(spark, d)
    paper = views.truths(boxes).select("page_id", "x", "y", (F.col("width") * 3).alias("width"), (F.col("height") * 3).alias("height"), (F.col("page_id") % 5 / 4.0).alias("confidence"))
    return done(detect.paper_score(boxes, paper).select("page_id", "det_idx", "paper_score"))
