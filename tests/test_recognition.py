import math

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import numeric, text
from quire.operators import evaluate, recognise, retry
from quire.plans import pages
from quire.plans.config import Options


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_edit_distance_counts_code_points(spark):
    for a, b, want in (("かな", "かさな", 1), ("", "漢", 1), ("", "", 0), ("😀a", "a", 1)):
        assert one(spark, text.edit_distance(F.lit(a), F.lit(b))) == want
    assert one(spark, text.cer(F.lit(""), F.lit("x"))) == 1 and one(spark, text.cer(F.lit(""), F.lit(""))) == 0
    assert one(spark, text.normalized_distance(F.lit(""), F.lit(""))) == 0


def test_trim_utf16_and_hash(spark):
    assert one(spark, text.trim(F.lit("　 甲 ﻿"))) == "甲"
    assert one(spark, text.utf16_length(F.lit("😀a"))) == 3

    def fnv(s):
        h = 2166136261
        data = s.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[i : i + 2], "big")) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    for s in ("", "a", "甲乙", "😀", "x" * 300):
        assert one(spark, text.fnv1a(F.lit(s))) == fnv(s)
    assert one(spark, text.nfkc(F.lit("ｱ１"))) == "ア1"
    assert [one(spark, text.percent(F.lit(v).cast("double"))) for v in (None, 0.5, 2.0, 0.125)] == ["—", "50%", "100%", "13%"]


def test_merging_pieces(spark):
    merge = lambda *p: one(spark, text.merge_pieces(F.array(*[F.lit(x) for x in p])))
    cases = [("甲乙", "乙丙", "丙丁"), ("abc", "xyz"), ("", "abc"), ("abcdef", "cdXfgh"), ("a",), ("aab", "abaab"), ("kitten sat", "sitten sat on")]
    for case in cases:
        assert merge(*case) == retry.merge_texts(list(case))
    assert merge("甲乙", "乙丙", "丙丁") == "甲乙丙丁" and merge("abc", "xyz") is None
    assert one(spark, text.merge_pieces(F.expr("cast(array() as array<string>)"))) is None


def test_log_softmax(spark):
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = one(spark, numeric.log_softmax(array(1000, 999, 998)))
    assert abs(sum(map(math.exp, got)) - 1) < 1e-9
    assert one(spark, numeric.log_softmax(array("nan", "inf"))) == [-math.log(2)] * 2
    assert one(spark, numeric.log_softmax(array(0, "nan")))[1] == float("-inf")
    assert one(spark, numeric.upper_median(array(3, 1, 2, 4))) == 3 and one(spark, numeric.upper_median(F.expr("cast(array() as array<double>)"), 255)) == 255
    assert one(spark, numeric.floor_percentile(array(4, 1, 3, 2), 0.5)) == 2


def test_decoding(spark):
    logits = F.array(*[F.lit(float(v)) for v in (-4, 5, 0, 6, 0, -2, 0, 0, 0)])
    r = one(spark, recognise.decode(logits, 3, 3, F.array(F.lit("甲"), F.lit("乙"))))
    assert r["text"] == "甲" and r["ended_with_eos"] and len(r["token_scores"]) == 1 and 0 < r["recognition_score"] <= 1
    flat = one(spark, recognise.decode(F.array(*[F.lit(v) for v in (0.0, 2.0, 2.0)]), 1, 3, F.array(F.lit("a"))))
    assert flat["text"] == "a" and not flat["ended_with_eos"] and flat["mean_token_margin"] == 0
    p = math.exp(2) / (1 + 2 * math.exp(2))
    eos = 1 / (1 + 2 * math.exp(2))
    assert abs(flat["recognition_score"] - math.sqrt(p * eos)) < 1e-12


def candidates(spark, rows):
    schema = "line int, ord int, text string, recognition_score double, minimum_token_score double, mean_token_margin double, ended_with_eos boolean, source string, preprocessing string"
    return spark.createDataFrame(rows, schema)


def test_selection_prefers_agreement(spark):
    frame = candidates(spark, [
        (0, 0, "甲", 0.8, 0.7, 2.0, True, "page", "original"), (0, 1, "甲", 0.7, 0.6, 1.0, True, "page", "padded"), (0, 2, "乙", 0.95, 0.9, 3.0, True, "page", "ink-channel"),
        (1, 0, "x", 0.8, 0.7, 2.0, True, "page", "original"), (1, 1, "yyyy", 0.8, 0.7, 2.0, True, "page", "padded"), (2, 0, "solo", 0.2, 0.1, 0.1, False, "page", "original"),
    ])
    got = {r["line"]: r for r in recognise.select_candidates(frame, "line").collect()}
    assert (got[0]["selected"]["text"], got[0]["reason"], got[0]["uncertain"], len(got[0]["alternatives"])) == ("甲", "consensus", False, 2)
    assert (got[1]["selected"]["text"], got[1]["reason"], got[1]["uncertain"]) == ("x", "original-tie", True)
    assert (got[2]["reason"], got[2]["uncertain"]) == ("score", False)
    both = {r["line"]: r for r in recognise.compare_strategies(frame, "line").collect()}
    assert both[0]["score_text"] == "乙" and both[0]["differs"] and not both[2]["differs"]


def test_low_confidence_rules(spark):
    def line(t="abc", s=0.9, m=0.5, g_=1.0, e=True, u=False):
        return F.struct(F.lit(t).alias("text"), F.lit(s).cast("double").alias("recognition_score"), F.lit(m).alias("minimum_token_score"), F.lit(g_).alias("mean_token_margin"), F.lit(e).alias("ended_with_eos"), F.lit(u).alias("uncertain"))

    box = g.make_box(*[F.lit(v) for v in (0.0, 0.0, 100.0, 10.0)])
    low = lambda c: one(spark, recognise.low_confidence(c, box, "balanced"))
    assert not low(line()) and low(line("　")) and low(line(s=0.57)) and low(line(m=0.27)) and low(line(g_=0.34)) and low(line(e=False)) and low(line("a")) and not low(line("😀"))
    shown = lambda c: one(spark, recognise.shown_as_low(c, "fast"))
    assert not shown(line(s=0.5)) and shown(line(s=None)) and shown(line(u=True))


def test_segments(spark):
    rows = [(0, 0, "甲乙", 0.8, 0.7, 1.0, True), (0, 1, "乙丙", 0.6, 0.5, 0.8, True), (1, 0, "ab", 1.0, 1.0, 1.0, True), (1, 1, "zz", 1.0, 1.0, 1.0, True)]
    frame = spark.createDataFrame(rows, "line int, index int, text string, recognition_score double, minimum_token_score double, mean_token_margin double, ended_with_eos boolean")
    got = {r["line"]: r for r in recognise.combine_segments(frame, "line").collect()}
    assert (got[0]["text"], got[0]["minimum_token_score"], got[0]["ended_with_eos"]) == ("甲乙丙", 0.5, True) and abs(got[0]["recognition_score"] - 0.7) < 1e-12
    assert got[1]["text"] is None


PRED = "page_id int, pred_idx long, text string, recognition_score double, ended_with_eos boolean, x double, y double, width double, height double"
TRUTH = "page_id int, ref_idx long, text string, normalized_text string, x double, y double, width double, height double"


def test_page_metrics(spark):
    pred = spark.createDataFrame([(0, 0, "甲", 0.8, True, 0.0, 0.0, 10.0, 10.0), (0, 1, "誤", 0.3, True, 20.0, 0.0, 10.0, 10.0), (1, 0, "甲", 0.9, True, 0.0, 0.0, 10.0, 10.0), (1, 1, "余", 0.9, True, 50.0, 0.0, 10.0, 10.0), (3, 0, "", 0.9, True, None, None, None, None)], PRED)
    truth = spark.createDataFrame([(0, 0, "甲", None, 0.0, 0.0, 10.0, 10.0), (0, 1, "正", None, 20.0, 0.0, 10.0, 10.0), (1, 0, "甲", None, 0.0, 0.0, 10.0, 10.0), (2, 0, "丙", "丙丁", 0.0, 0.0, 1.0, 1.0)], TRUTH)
    got = {r["page_id"]: r for r in evaluate.page_metrics(pred, truth, normalize=lambda c: F.upper(c)).collect()}
    assert (got[0]["recall"], got[0]["precision"], got[0]["cer"], got[0]["exact_rate"], got[0]["error_detection_rate"], got[0]["order_accuracy"]) == (1, 1, 0.5, 0.5, 1, 1)
    assert (got[1]["cer"], got[1]["precision"], got[1]["f1"]) == (1, 0.5, 2 / 3)
    assert (got[2]["cer"], got[2]["recall"], got[2]["reference_characters"], got[2]["order_accuracy"], got[2]["normalized_cer"]) == (1, 0, 2, 0, 1)
    assert (got[3]["cer"], got[3]["empty_rate"], got[3]["predicted"]) == (0, 1, 1)


def test_matches_are_one_to_one(spark):
    pred = spark.createDataFrame([(0, i, "", 1.0, True, float(i * 2), 0.0, 10.0, 10.0) for i in range(20)], PRED)
    truth = spark.createDataFrame([(0, i, "", None, float(i * 3), 0.0, 10.0, 10.0) for i in range(12)], TRUTH)
    m = evaluate.match_regions(pred, truth).collect()
    assert len({r["pred_idx"] for r in m}) == len({r["ref_idx"] for r in m}) == len(m) > 5


def test_options():
    assert Options.of(profile="accurate", max_extra_recognitions=999).max_extra_recognitions == 8
    assert Options.of(max_extra_recognitions=-1).max_extra_recognitions == 0
    accurate = Options.of(profile="accurate")
    assert accurate.max_extra_recognitions == 6 and accurate.adaptive_tiling and accurate.deskew_retry
    assert Options.of(profile="odd", writing_mode="odd") == Options.of()
    assert not Options.of(profile="accurate", deskew_retry=False).deskew_retry
    assert Options.of(scattered=True, profile="fast").stable_json() == Options.of(profile="fast", scattered=True).stable_json()


def test_retries_spend_the_budget_in_order(spark):
    def make_scorer():
        def score(a):
            if a.preprocessing == "original" and a.orientation == "auto" and a.deskew_angle is None:
                return retry.Decoded(f"l{a.det_idx}", 0.3, 0.2, 0.1, True)
            if a.preprocessing == "padded":
                return retry.Decoded(f"l{a.det_idx}!", 0.4, 0.3, 0.4, True)
            if a.source == "iiif-crop":
                raise OSError("no network")
            return retry.Decoded(f"line {a.det_idx}", 0.9, 0.8, 2.0, True)

        return score

    rows = [(p, i, float(200 * i), 0.0, 30.0, 25.0, 0.5 + i / 100, 1000.0, 800.0) for p in range(3) for i in range(4)]
    boxes = spark.createDataFrame(rows, "page_id int, det_idx long, x double, y double, width double, height double, score double, image_width double, image_height double")
    padded = boxes.selectExpr("*", "x as px", "y as py", "width as pwidth", "height as pheight", "true as has_crops")
    found = retry.recognise_pages(padded, make_scorer, Options.of(profile="balanced", max_extra_recognitions=3)).collect()
    by_page = {p: sorted((r["det_idx"], r["ord"], r["preprocessing"], r["orientation"]) for r in found if r["page_id"] == p) for p in range(3)}
    # the first line takes direction, padded and (failing) crop; nothing is left for the others
    assert by_page[0] == by_page[1] == by_page[2] == [(0, 0, "original", "auto"), (0, 1, "original", "rotate-90"), (0, 2, "padded", "auto"), (1, 0, "original", "auto"), (2, 0, "original", "auto"), (3, 0, "original", "auto")]
    lines = pages.recognise(boxes, make_scorer, Options.of(profile="accurate", adaptive_tiling=False))
    assert lines.count() == 12 and {r["reading_order"] for r in lines.where("page_id = 0").collect()} == {0, 1, 2, 3}
    stats = pages.run_stats(retry.recognise_pages(padded, make_scorer, Options.of(profile="accurate"))).collect()
    assert {r["extra_attempts"] for r in stats} == {6}


def test_long_lines_are_segmented():
    text = "abcdefghijkl"
    parts = retry.windows((0, 0, 400, 20), 4)
    assert len(parts) == 4 and parts[0][0] == 0 and abs(parts[-1][0] + parts[-1][2] - 400) < 1e-9

    def scorer(a):
        if a.region[2] == 400:
            return retry.Decoded("", 0.1, 0.1, 0.1, False)
        i = parts.index(a.region) * 3
        return retry.Decoded(text[i : i + 5], 0.9, 0.9, 2.0, True)

    budget = retry.Budget(8)
    found = retry.recognise_line("p", 0, (0, 0, 400, 20), (0, 0, 400, 20), scorer, Options.of(profile="balanced", long_line_segmentation=True, max_extra_recognitions=8), budget, False, None, retry.merge_texts)
    assert found[-1][0].source == "segmented" and found[-1][1].text == text


def test_fallback():
    told = []
    assert retry.with_fallback(lambda: 1 / 0, lambda: "b", told=told.append) == "b" and len(told) == 1
    with pytest.raises(ZeroDivisionError):
        retry.with_fallback(lambda: 1 / 0, lambda: "b", aborted=lambda: True)


def test_results_scale_to_the_page(spark):
    lines = spark.createDataFrame([(0, 10.0, 20.0, 5.0, 5.0), (9, 1.0, 1.0, 1.0, 1.0)], "page_id int, x double, y double, width double, height double")
    sizes = spark.createDataFrame([(0, 200.0, 0.0, 100.0, 50.0)], "page_id int, width double, height double, image_width double, image_height double")
    assert [tuple(r) for r in pages.apply_result(lines, sizes).collect()] == [(0, 20.0, 20.0, 10.0, 5.0)]


def test_tiles_add_detections(spark):
    boxes = spark.createDataFrame([(0, 0, 0.0, 0.0, 20.0, 60.0, 0.9)], "page_id int, det_idx long, x double, y double, width double, height double, score double")
    tiles = spark.createDataFrame([(0, "1-0", 0.0, 100.0, 100.0, 100.0, 100, 200)], "page_id int, tile_id string, x double, y double, width double, height double, page_width int, page_height int")
    local = spark.createDataFrame([(0, "1-0", 0, 60.0, 90.0, 20.0, 60.0, 0.8), (0, "1-0", 1, 0.0, -100.0, 20.0, 160.0, 0.5)], "page_id int, tile_id string, det_idx long, x double, y double, width double, height double, score double")
    rows = sorted((r["x"], r["y"], r["width"], r["height"]) for r in pages.with_tiles(boxes, local, tiles, Options.of(writing_mode="vertical")).collect())
    assert rows == [(0.0, 0.0, 20.0, 60.0), (60.0, 190.0, 20.0, 10.0)]
