"""Benchmark records and files, options that need inputs, split lines, and the dictionary in one pass."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.operators import dictionary, retry, tiles
from quire.plans import pages
from quire.plans.config import Options
from quire.sources import records, synonyms


@pytest.mark.parametrize(
    ("value", "want"),
    [(1.0, "1"), (0.5, "0.5"), (1e-5, "0.00001"), (1.25e-6, "0.00000125"), (1e-7, "1e-7"), (2.5e-9, "2.5e-9"), (12345678.0, "12345678"), (1.5e20, "150000000000000000000"), (1e21, "1e+21"), (-0.25, "-0.25"), (-3e-6, "-0.000003"), (123456.789, "123456.789")],
)
def test_numbers_as_a_browser_writes_them(spark, value, want):
    assert spark.createDataFrame([(value,)], "v double").select(records.number(F.col("v"))).first()[0] == want
    assert records._json(value) == want


def test_json_files_are_indented_by_two(spark):
    frame = spark.createDataFrame([("c", 1.0, [], [(1, None)], {"k": "\u00e9"})], "canvasId string, cer double, none array<int>, lines array<struct<i:int,t:string>>, tags struct<k:string>")
    text = records.json_lines(frame).first()["value"]
    assert text == '{\n  "canvasId": "c",\n  "cer": 1,\n  "none": [],\n  "lines": [\n    {\n      "i": 1\n    }\n  ],\n  "tags": {\n    "k": "\u00e9"\n  }\n}\n'


BOX = "x double, y double, width double, height double"


def test_records_of_a_run(spark):
    found = spark.createDataFrame([("a", "http://m", 100.0, 200.0, 50.0), ("b", None, 10.0, 20.0, None), ("c", None, None, None, None)], "canvasId string, manifestUrl string, width double, height double, imageWidth double")
    lines = spark.createDataFrame([("a", 0, "one", 0.9, 0.8, 0.0, 0.0, 10.0, 10.0), ("a", 1, "twx", 0.9, 0.2, 0.0, 50.0, 10.0, 10.0), ("b", 0, "q", 0.9, 0.9, 0.0, 0.0, 5.0, 5.0)], f"canvasId string, detectionIndex int, text string, detectionScore double, recognitionScore double, {BOX}")
    truth = spark.createDataFrame([("a", 0, "one", 0.0, 0.0, 10.0, 10.0), ("a", 1, "two", 0.0, 50.0, 10.0, 10.0)], f"canvasId string, ref_idx int, text string, {BOX}")
    got = {r["canvasId"]: r for r in pages.run_dataset(found, lines, truth, Options.of(profile="fast"), engine="me").collect()}
    a, b, c = (got[k] for k in "abc")
    assert a["schemaVersion"] == 2 and a["page"]["manifestUrl"] == "http://m" and a["execution"]["browser"] == "me" and json.loads(a["execution"]["options"])["profile"] == "fast"
    assert (a["output"]["imageWidth"], b["output"]["imageWidth"], c["output"]["imageWidth"]) == (50.0, 10.0, None)
    assert [x["text"] for x in a["output"]["lines"]] == ["one", "twx"] and c["output"]["lines"] == [] and json.loads(c["output"]["fingerprint"]) == []
    assert json.loads(a["output"]["fingerprint"])[0]["alternatives"] == []
    assert abs(a["metrics"]["cer"] - 1 / 6) < 1e-9 and a["metrics"]["error_detection_rate"] == 1.0
    assert b["metrics"] is None and c["metrics"] is None and c["modelRevision"] == "unknown"
    assert pages.run_dataset(found.limit(0), lines, truth, Options.of()).count() == 0
    assert pages.run_dataset(found, lines, None, Options.of()).count() == 3


@pytest.fixture
def scorer():
    # defined inside, so that workers need not import this module
    def make():
        return lambda a: retry.Decoded(f"line {a.det_idx}", 0.1 if a.det_idx == 0 else 0.9, 0.9, 2.0, True, 0.9)

    return make


def page_boxes(spark):
    rows = [(1, 0, 10.0, 10.0, 12.0, 100.0, 0.9), (1, 1, 60.0, 10.0, 12.0, 100.0, 0.8)]
    return spark.createDataFrame(rows, f"page_id int, det_idx long, {BOX}, score double").withColumns({"image_width": F.lit(100.0), "image_height": F.lit(150.0)})


def test_options_without_their_input_are_refused(spark, scorer):
    boxes = page_boxes(spark)
    with pytest.raises(ValueError, match="tiling"):
        pages.recognise(boxes, scorer, Options.of(profile="accurate"))
    with pytest.raises(ValueError, match="paper"):
        pages.recognise(boxes, scorer, Options.of(paper_filter="soft"))


def test_paper_tiles_and_gaps_take_effect(spark, scorer):
    boxes = page_boxes(spark)
    paper = spark.createDataFrame([(1, 55.0, 0.0, 40.0, 150.0, 0.9)], f"page_id int, {BOX}, confidence double")
    kept = pages.recognise(boxes, scorer, Options.of(profile="fast", paper_filter="soft"), paper=paper).collect()
    assert [r["x"] for r in kept] == [60.0]
    local = lambda cut: cut.select("page_id", "tile_id", F.lit(0).cast("long").alias("det_idx"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(6.0).alias("width"), F.lit(30.0).alias("height"), F.lit(0.5).alias("score"))
    more = pages.recognise(boxes, scorer, Options.of(profile="balanced", adaptive_tiling=True), detect_tiles=local)
    assert more.count() > 2
    ink = spark.createDataFrame([(1, 1, [0.2] * 30 + [0.0] * 12 + [0.2] * 58, 1)], "page_id int, det_idx long, projection array<double>, step int")
    split = tiles.split_detections(boxes, ink).orderBy("det_idx").collect()
    assert [(r["det_idx"], r["y"], r["height"]) for r in split] == [(0, 10.0, 100.0), (1, 10.0, 30.0), (2, 52.0, 58.0)]


def test_counters(spark, scorer):
    found = retry.recognise_pages(page_boxes(spark).withColumns({f"p{c}": F.col(c) for c in ("x", "y", "width", "height")} | {"has_crops": F.lit(True)}), scorer, Options.of(profile="balanced"))
    cut = spark.createDataFrame([(1, "a", 50.0, 60.0)], "page_id int, tile_id string, width double, height double")
    requests = spark.createDataFrame([(1, True), (1, False)], "page_id int, failed boolean")
    (r,) = pages.run_stats(found, cut=cut, requests=requests, seconds=1.5).collect()
    assert r["initial_recognitions"] == 2 and r["extra_recognitions"] == r["candidate_count"] - 2 and r["model_inference_count"] == 2 + r["candidate_count"]
    assert (r["adaptive_tiles"], r["max_canvas_pixels"], r["additional_crop_requests"], r["additional_crop_failures"], r["duration_ms"]) == (1, 3000.0, 2, 1, 1500)
    (r,) = pages.run_stats(found).collect()
    assert (r["adaptive_tiles"], r["max_canvas_pixels"], r["additional_crop_requests"]) == (0, None, 0)


def test_search_equals_a_plain_search(spark, monkeypatch):
    rng = random.Random(5)
    entries = [(i, "".join(rng.choices("abcd", k=2)), ["".join(rng.choices("abcdefg", k=rng.randint(1, 3))) for _ in range(3)] + ["\uff21"]) for i in range(12)]
    texts = [(i, "".join(rng.choices("abcdefg \uff21\uff42", k=rng.randint(0, 25)))) for i in range(200)] + [(900, None), (901, "  "), (902, "x" * 20_000 + "ab")]
    table = spark.createDataFrame(entries, "entry_idx int, normalized string, variants array<string>")
    docs = spark.createDataFrame(texts, "k int, text string")
    for fold in (True, False):
        want = set()
        for k, t in texts:
            t = (t or "").strip()
            forms = {t, unicodedata.normalize("NFKC", t)} if fold else {t}
            for i, n, vs in entries:
                at = [f.find(w) for f in forms for w in (n, *vs) if w in f]
                if t == "" or at:
                    want.add((k, i, n, min(at) if t else -1))
        got = dictionary.search(docs, table, "k", fold=fold)
        assert {(r["k"], r["entry_idx"], r["normalized"], r["position"]) for r in got.collect()} == want
        assert got.where("rank = 0").count() == len({w[0] for w in want})
    monkeypatch.setattr(dictionary, "MOST_PAIRS", 20)
    with pytest.raises(ValueError, match="terms"):
        dictionary.search(docs, table, "k")


def test_statements_of_other_shapes_are_passed_over(spark, tmp_path):
    rows = ["INSERT INTO synonyms VALUES ('a''b', 'c');", "INSERT INTO synonyms VALUES ('a', 'c') ;", "INSERT INTO other VALUES ('x', 'y');", "INSERT INTO synonyms VALUES ('d', 'c', 'e');", " INSERT INTO synonyms VALUES ('f', 'c');", "INSERT INTO synonyms VALUES ('\u9f4a', 'c');"]
    (tmp_path / "d.sql").write_text("\n".join(rows))
    (r,) = synonyms.read_synonyms(spark, str(tmp_path / "d.sql"), least=2).collect()
    assert (r["normalized"], r["variants"]) == ("c", ["a'b", "\u9f4a"])
