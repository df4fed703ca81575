import numpy as np
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import crops, detect, order, tiles

BOXES = "page_id int, det_idx long, x double, y double, width double, height double, score double"


def boxes(spark, rows, scores=None):
    return spark.createDataFrame([(0, i, *map(float, r), float(scores[i]) if scores else 0.5) for i, r in enumerate(rows)], BOXES)


def literal(x, y, w, h):
    return g.make_box(*[F.lit(float(v)) for v in (x, y, w, h)])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_suppression_drops_contained_boxes(spark):
    frame = boxes(spark, [(310, 40, 33, 17), (12, 9, 51, 30), (20, 14, 21, 13), (150, 220, 18, 64), (151, 221, 16, 62)], [0.61, 0.93, 0.92, 0.35, 0.34])
    assert [r["score"] for r in detect.global_nms(frame).orderBy("rank").collect()] == [0.93, 0.61, 0.35]


def test_suppressed_boxes_do_not_suppress_and_thresholds_are_inclusive(spark):
    # b overlaps a by 2/3, c overlaps b by 2/3 but a by 1/3
    frame = boxes(spark, [(0, 0, 10, 10), (2, 0, 10, 10), (4, 0, 10, 10)], [0.9, 0.8, 0.7])
    assert [r["det_idx"] for r in detect.global_nms(frame, iou=0.5).orderBy("rank").collect()] == [0, 2]
    assert detect.global_nms(boxes(spark, [(0, 0, 10, 10), (0, 0, 10, 20)], [1, 1]), iou=0.5, smaller=2).count() == 1


def test_fragments_of_a_column_merge_but_columns_do_not(spark):
    frame = boxes(spark, [(211, 15, 14, 52), (211, 70, 14, 45), (180, 15, 14, 100)], [0.52, 0.58, 0.91])
    rows = {r["x"]: r for r in detect.merge_adjacent(frame, orientation="vertical").collect()}
    assert len(rows) == 2
    assert tuple(rows[211.0])[2:7] == (211.0, 15.0, 14.0, 100.0, 0.58) and rows[211.0]["paper_score"] is None


def test_merging_keeps_the_least_paper_score(spark):
    frame = boxes(spark, [(0, 0, 10, 40), (0, 42, 10, 40), (0, 84, 10, 40)]).withColumn("paper_score", F.when(F.col("det_idx") < 2, F.col("det_idx") / 2 + 0.25))
    assert [r["paper_score"] for r in detect.merge_adjacent(frame).collect()] == [0.25]


def test_adjacent_expression_agrees_with_the_kernel(spark):
    a, b, far = literal(211, 15, 14, 52), literal(211, 70, 14, 45), literal(180, 15, 14, 100)
    assert one(spark, detect.adjacent(a, b, True)) and not one(spark, detect.adjacent(a, far, True))


def test_whole_pixels_and_padding(spark):
    assert tuple(one(spark, g.whole_pixels(literal(1.2, 2.8, 3.1, 4.1), F.lit(10.0), F.lit(10.0)))) == (1, 2, 4, 5)
    frame = boxes(spark, [(40, 20, 10, 100), (52, 20, 10, 100)])
    near = crops.transverse_clearance(frame).where("det_idx = 0")
    p = near.select(crops.expand_in(g.box(), F.col("before"), F.col("after"), F.lit(100.0), F.lit(150.0), longitudinal=0.1, transverse=0.5).alias("p")).first()["p"]
    assert (p["x"], p["y"], p["x"] + p["width"], p["y"] + p["height"]) == (35, 10, 51, 130)


def test_crop_addresses(spark):
    url = lambda service: one(spark, crops.line_crop_url(F.lit(service), F.lit(1000.0), F.lit(2000.0), F.lit(100.0), F.lit(200.0), literal(10, 20, 10, 40), 512))
    assert url("https://example.test/iiif/service") == "https://example.test/iiif/service/100,200,100,400/!512,512/0/default.jpg"
    assert url("") == ""
    assert one(spark, crops.page_image_url(F.lit("https://s/"), F.lit("x"))) == "https://s/full/2000,/0/default.jpg"
    assert one(spark, crops.dragged_region(F.lit(5.0), F.lit(9.0), F.lit(3.0), F.lit(2.0)))["width"] == 2
    assert one(spark, crops.dragged_region(F.lit(5.0), F.lit(9.0), F.lit(5.1), F.lit(2.0))) is None


def ordered(spark, rows, **how):
    got = order.reading_order(boxes(spark, rows), **how).orderBy("reading_order").collect()
    return [r["det_idx"] for r in got]


def test_reading_orders(spark):
    # columns from the right, each from the top, given from the left and the bottom
    assert ordered(spark, [(31, 140, 15, 90), (33, 12, 15, 95), (240, 150, 15, 88), (238, 10, 15, 92)]) == [3, 2, 1, 0]
    # three touching columns of one block
    assert ordered(spark, [(60, 5, 17, 130), (77, 5, 17, 130), (94, 5, 17, 130)]) == [2, 1, 0]
    # rows from the top; scattered lines keep the order of detection
    assert ordered(spark, [(14, 170, 210, 18), (12, 33, 205, 18), (15, 96, 200, 18)]) == [1, 2, 0]
    assert ordered(spark, [(14, 170, 210, 18), (12, 33, 205, 18)], scattered=True) == [0, 1]
    # the mode given outweighs the boxes' own
    assert ordered(spark, [(180, 7, 16, 70), (20, 7, 16, 70)], mode="horizontal") == [1, 0]
    assert ordered(spark, [(180, 7, 16, 70), (20, 7, 16, 70)]) == [0, 1]


def test_reading_order_is_a_permutation(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.randint(0, 300), rng.randint(0, 300), rng.randint(5, 60), rng.randint(5, 60)) for _ in range(60)]
    assert sorted(ordered(spark, rows)) == list(range(60))


def test_orientation_rules_differ(spark):
    frame = boxes(spark, [(0, 0, 10, 13), (0, 0, 13, 10)])
    assert detect.orientation_votes(frame).first()["orientation"] == "vertical"
    assert order.writing_mode(frame).first()["mode"] == "vertical"
    assert order.writing_mode(boxes(spark, [(0, 0, 10, 11), (0, 0, 10, 11)])).first()["mode"] == "horizontal"


def test_tiles(spark):
    frame = boxes(spark, [(10, 220, 20, 20)]).withColumns({"page_width": F.lit(100), "page_height": F.lit(300)})
    rows = tiles.adaptive_tiles(frame, "balanced").collect()
    assert [r["tile_id"] for r in rows] == ["2-0", "1-0"][: len(rows)] and 0 < len(rows) <= 2
    assert tiles.adaptive_tiles(frame, "fast").count() == 0
    r = rows[0]
    restored = one(spark, g.restore(literal(r["x"], r["y"], r["width"], r["height"]), literal(1, 2, 3, 4), F.lit(100.0), F.lit(300.0)))
    assert restored["x"] >= 0 and restored["x"] + restored["width"] <= 100


def test_tiles_of_equal_coverage_go_by_id(spark):
    # 3 x (245 1/3 - 240) in the first tile and 4 x 4 in the last are both 16; as doubles the first is 15.99999999999994
    frame = boxes(spark, [(0, 240, 3, 20), (0, 500, 4, 4)]).withColumns({"page_width": F.lit(420.0), "page_height": F.lit(640.0)})
    assert [(r["rank"], r["tile_id"]) for r in tiles.adaptive_tiles(frame, "accurate").orderBy("rank").collect()] == [(1, "1-0"), (2, "0-0"), (3, "2-0")]
    assert [r["tile_id"] for r in tiles.adaptive_tiles(frame, "balanced").orderBy("rank").collect()] == ["1-0", "0-0"]


def test_windows_and_gaps(spark):
    assert len(one(spark, tiles.line_windows(literal(0, 0, 400, 20), F.lit(400.0), F.lit(40.0), most=3))) == 3
    assert len(one(spark, tiles.line_windows(literal(0, 0, 100, 20), F.lit(400.0), F.lit(40.0)))) == 1
    array = lambda *parts: F.array(*[F.lit(v) for n, v in parts for _ in range(n)])
    gap = one(spark, tiles.ink_gap(array((32, 0.2), (12, 0.0), (70, 0.2)), F.lit(12.0)))
    assert tuple(gap) == (32, 44)
    assert one(spark, tiles.ink_gap(array((45, 0.2), (12, 0.0), (45, 0.2)), F.lit(12.0))) is None
    assert one(spark, tiles.ink_gap(array((2, 0.2)), F.lit(12.0))) is None
    split = one(spark, tiles.split_at_gap(literal(5, 7, 114, 12), F.struct(F.lit(32).alias("start"), F.lit(44).alias("end")), F.lit(1)))
    assert [tuple(b) for b in split] == [(5, 7, 32, 12), (49, 7, 70, 12)]


def test_paper(spark):
    frame = boxes(spark, [(0, 0, 10, 10), (50, 50, 10, 10), (0, 0, 0, 5)])
    paper = spark.createDataFrame([(0, 0.0, 0.0, 5.0, 10.0, 0.6)], "page_id int, x double, y double, width double, height double, confidence double")
    got = {r["det_idx"]: r["paper_score"] for r in detect.paper_score(frame, paper).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: 0.0}
    assert {r["paper_score"] for r in detect.paper_score(frame, paper.withColumn("confidence", F.lit(0.0))).collect()} == {0.5}
    drop = lambda c, s, t, r: one(spark, detect.suppressed_by_paper(F.lit(c), F.lit(s), F.lit(t), F.lit(r).cast("double")))
    assert drop(0.4, 0.0, "　", None) and drop(0.4, 0.0, "a", 0.2) and not drop(0.4, 0.0, "a", None) and not drop(0.3, 0.0, "", 0.1)


def test_detection_filter(spark):
    rows = [(10, 10, 50, 40, 0.9), (10, 10, 50, 40, 0.24), (10, 10, 12, 40, 0.9), (90, 10, 130, 40, 0.9), (60, 10, 160, 40, 0.9), (30, 40, 20, 50, 0.9), (10, 10, 50, 40, float("nan"))]
    raw = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "det_idx int, x1 double, y1 double, x2 double, y2 double, score double")
    got = {r["det_idx"]: r for r in detect.filter_detections(raw, 0.24, 1024, 100, 100).collect()}
    assert sorted(got) == [0]
    assert (got[0]["y"], got[0]["height"]) == (9.0, 32.0)


def test_suppression_replayed(spark):
    rng = np.random.default_rng(3)
    pages = {0: 1, 1: 7, 2: 63, 3: 64, 4: 65, 5: 400}
    rows = [(p, i, *map(float, rng.integers(0, 60 if n < 100 else 300, 2)), *map(float, rng.integers(0, 30, 2)), float(rng.integers(0, 9)) / 8) for p, n in pages.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "page_id long, det_idx long, x double, y double, width double, height double, score double")

    def share(a, b):
        common = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        u, s = a[2] * a[3] + b[2] * b[3] - common, min(a[2] * a[3], b[2] * b[3])
        return (common / u if u > 0 else 0.0), (common / s if s > 0 else 0.0)

    want = set()
    for p in pages:
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[6], r[1])):
            if not any(share(r[2:6], k[2:6])[0] >= 0.5 or share(r[2:6], k[2:6])[1] >= 0.8 for k in kept):
                kept.append(r)
        want |= {(p, r[1], k) for k, r in enumerate(kept)}
    assert {tuple(r) for r in detect.global_nms(frame, iou=0.5, smaller=0.8).select("page_id", "det_idx", "rank").collect()} == want
