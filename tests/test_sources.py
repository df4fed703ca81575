import json

import pytest
from pyspark.sql import functions as F

from quire.operators import dictionary
from quire.sources import cache, manifest, records, responses, synonyms, truth
from quire.streaming import arrivals

V2 = {
    "@id": "https://x.example/biblio/200021552/manifest", "label": [{"@value": "題", "@language": "ja"}, {"@value": "Title", "@language": "en"}], "license": "https://l",
    "sequences": [{"canvases": [
        {"@id": "c1", "label": "表", "width": 10, "height": 20, "images": [{"resource": {"@id": "i1", "service": {"@id": "https://s/1/"}}}]},
        {"@id": "c2", "images": [{"resource": {}}]},
        {"images": [{"resource": {"@id": "i3", "width": 7, "height": 8}}]},
    ]}],
}
V3 = {
    "id": "https://y.example/m", "label": {"en": ["One", "Two"], "none": ["N"]}, "rights": ["https://r"], "requiredStatement": {"label": {"en": ["By"]}, "value": {"en": ["Owner"]}}, "viewingDirection": "left-to-right",
    "items": [{"id": "k1", "label": {"fr": ["un"]}, "width": 3, "height": 4, "items": [{"items": [{"body": {"id": "b1", "service": [{"id": "https://t/1"}]}}]}]}],
}


def test_manifests(spark, tmp_path):
    raw = spark.createDataFrame([("https://h2.example/a", json.dumps(V2)), ("https://h3.example/b", json.dumps(V3)), ("https://h4.example/c", "{"), ("https://h5.example/d", "{}")], "source_url string, raw string")
    m, p = manifest.parse_manifests(raw)
    got = {r["source_url"][8:10]: r for r in m.collect()}
    assert (got["h2"]["title"], got["h2"]["record_id"], got["h2"]["license"], got["h2"]["attribution"], got["h2"]["viewing_direction"], got["h2"]["n_pages"]) == ("題", "200021552", "https://l", "h2.example", "right-to-left", 2)
    assert (got["h3"]["title"], got["h3"]["record_id"], got["h3"]["license"], got["h3"]["attribution"], got["h3"]["viewing_direction"]) == ("N", "EXTERNAL", "https://r", "Owner", "left-to-right")
    assert got["h4"]["error"] == "not JSON" and got["h5"]["error"] == "no pages" and got["h3"]["error"] is None
    pages = {(r["source_url"][8:10], r["canvas_index"]): r for r in p.collect()}
    assert sorted(pages) == [("h2", 0), ("h2", 2), ("h3", 0)]
    a, b, c = pages["h2", 0], pages["h2", 2], pages["h3", 0]
    assert (a["canvas_id"], a["image_service_id"], a["label"], a["image"], a["width"]) == ("c1", "https://s/1", "表", "https://s/1/full/1200,/0/default.jpg", 10.0)
    assert (b["canvas_id"], b["label"], b["image"], b["thumbnail"], b["height"], b["label_translations"]) == ("https://h2.example/a#canvas-3", "3", "i3", "i3", 8.0, {"none": "3"})
    assert (c["label"], c["thumbnail"]) == ("un", "https://t/1/full/180,/0/default.jpg")
    assert manifest.requests(p, m, "edo").count() == 3
    (tmp_path / "m.json").write_text(json.dumps(V3))
    assert manifest.read_manifests(spark, str(tmp_path)).count() == 1
    visits = spark.createDataFrame([("https://h2.example/a", 1, 2, "c1", None), ("https://h2.example/a", 2, 9, "c1", None), ("https://h2.example/a", 3, None, "zz", "https://h2.example/a#canvas-3"), ("https://h2.example/a", 4, None, None, None)], "source_url string, visit_id int, canvas_number int, previous_canvas_id string, stored_canvas_id string")
    assert {r["visit_id"]: r["page_index"] for r in manifest.initial_page(p, visits).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_localised_texts():
    assert manifest.localized(["a", {"@value": "b", "@language": "en"}, {"de": ["c", "d"], "id": "no"}]) == {"none": "a", "en": "b", "de": "c"}
    assert manifest.localized({"value": {"x": "y"}}) == {"x": "y"} and manifest.localized(None) == {}


def test_routes(spark):
    template = "https://x.example/biblio/{id}/manifest"
    row = spark.createDataFrame([("/12/", "https://x.example/biblio/12/manifest/", "3"), ("/a", "https://other", "03")], "p string, u string, c string")
    got = row.select(manifest.manifest_url_of_path(F.col("p"), template).alias("u"), manifest.path_of_manifest_url(F.col("u"), template, canvas=manifest.canvas_number(F.col("c"))).alias("p"), manifest.canvas_number(F.col("c")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("https://x.example/biblio/12/manifest", "/12?canvas=3", 3), (None, "/", None)]
    urls = spark.createDataFrame([(" https://a.b/c ",), ("http://a.b",)], "u string").select(manifest.valid_address(F.col("u")).alias("v")).collect()
    assert [r["v"] for r in urls] == ["https://a.b/c", None]


def test_ground_truth(spark):
    line = {"text": "甲", "region": {"x": 1, "y": 2.5, "width": 3, "height": 4}}
    good = {"id": "i", "manifestUrl": "m", "canvasId": "c", "lines": [line, line | {"normalizedText": "乙"}], "tags": ["kana"], "width": 9}
    rows = [good, good | {"tags": ["a", 1]}, good | {"lines": [{"text": "x"}]}, good | {"id": 5}, good | {"lines": "no"}, []]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("{",)], "raw string")
    pages, bad = truth.parse_truth(raw)
    got = pages.collect()
    assert [r["tags"] for r in got] == [["kana"], []] and (got[0]["width"], got[0]["height"], got[0]["image_service_id"]) == (9.0, 0.0, "")
    assert sorted(r["error"] for r in bad.collect()) == ["each line requires a text and a region of numbers", "id, manifestUrl and canvasId are required", "lines must be an array", "not JSON", "not an object"]
    lines = truth.truth_lines(pages).collect()
    assert len(lines) == 4 and lines[0]["y"] == 2.5 and {r["normalized_text"] for r in lines} == {None, "乙"}
    with pytest.raises(ValueError):
        truth.strict(pages, bad)
    assert truth.viewer_pages(pages).first()["image"] == ""


def test_dictionary(spark, tmp_path):
    dump = "x\nINSERT INTO synonyms VALUES ('麻呂', '麿');\nINSERT INTO synonyms VALUES ('齊', '斉');\nINSERT INTO synonyms VALUES ('齊', '斎');\nINSERT INTO synonyms VALUES ('斉', '斎');\nINSERT INTO synonyms VALUES ('it''s', 'b');\nINSERT INTO synonyms VALUES ('齊', '斉');\n"
    (tmp_path / "d.sql").write_text(dump)
    entries = synonyms.read_synonyms(spark, str(tmp_path / "d.sql"), least=5)
    got = [(r["normalized"], r["variants"]) for r in entries.orderBy("entry_idx").collect()]
    assert got == [("麿", ["麻呂"]), ("斉", ["齊"]), ("斎", ["齊", "斉"]), ("b", ["it's"])]
    with pytest.raises(ValueError):
        synonyms.read_synonyms(spark, str(tmp_path / "d.sql"))
    ordered = dictionary.resolve(entries)
    texts = ["齊麻呂", "斉it's", "", "麻麻呂呂"]
    want = []
    for t in texts:
        for variant, target in ordered:
            t = t.replace(variant, target)
        want.append(t)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r["v"] for r in frame.select("i", dictionary.normalize(F.col("text"), ordered).alias("v")).orderBy("i").collect()] == want
    found = dictionary.search(frame, entries, "i").collect()
    assert sorted((r["i"], r["normalized"], r["position"]) for r in found if r["i"] == 0) == [(0, "斉", 0), (0, "斎", 0), (0, "麿", 1)]
    assert sum(r["i"] == 2 for r in found) == 4 and dictionary.page_of_results(dictionary.search(frame, entries, "i"), 1).count() == 4


def test_random_chains_fold_into_one_translation(spark):
    import random

    rng = random.Random(2)
    for _ in range(5):
        rows = [(i, rng.choice("abcdef"), [rng.choice("abcdef") for _ in range(2)]) for i in range(6)]
        entries = spark.createDataFrame(rows, "entry_idx int, normalized string, variants array<string>")
        ordered = dictionary.resolve(entries)
        want = "abcdefabc"
        for v, t in ordered:
            want = want.replace(v, t)
        assert spark.range(1).select(dictionary.normalize(F.lit("abcdefabc"), ordered).alias("v")).first()["v"] == want


def test_records(spark):
    row = "named_struct('id', 'line-0', 'text', 'a', 'detectionScore', 0.5D)"
    fp = lambda r: spark.range(1).select(records.lines_fingerprint(F.expr(f"array({r})"), ["id", "text", "detectionScore"]).alias("f")).first()["f"]
    assert json.loads(fp(row))[0]["uncertain"] is False and json.loads(fp(row))[0]["alternatives"] == [] and json.loads(fp(row))[0]["eosScore"] is None
    assert fp(row) == fp(row) != fp(row.replace("'a'", "'b'"))
    a = spark.createDataFrame([("c1", "x", "2024", "m"), ("c2", "y", "2024", "m")], "canvas_id string, text string, createdAt string, modelRevision string")
    b = spark.createDataFrame([("c1", "x", "2025", "m"), ("c3", "y", "2024", "m")], "canvas_id string, text string, createdAt string, modelRevision string")
    assert sorted(map(tuple, records.differing(a, b, records.record_fingerprint(a)).collect())) == [("c2", "missing in second"), ("c3", "missing in first")]
    base = records.create_baseline(a.withColumn("position", F.col("canvas_id")).withColumn("pipelineVersion", F.lit("p")), F.lit("now")).first()
    assert (base["modelRevision"], base["pipelineVersion"], len(base["records"])) == ("m", "p", 2)
    text = records.json_lines(a.limit(1)).first()["value"]
    assert text.endswith("\n") and json.loads(text)["canvas_id"] == "c1" and "\n" in text.strip()


def test_csv(spark, tmp_path):
    lines = spark.createDataFrame([(1, 'say "hi", you', 0.5, None), (0, "a\nb", None, True)], "lineIndex int, text string, cer double, endedWithEos boolean")
    rows = [r["value"] for r in lines.select(records.csv_row(lines).alias("value")).collect()]
    assert '"say ""hi"", you"' in rows[0] and '"a\nb"' in rows[1] and rows[1].count(",") == len(records.CSV_COLUMNS) - 1
    records.write_csv(lines, str(tmp_path / "out"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert whole.startswith("schemaVersion,") and whole.index("a\nb") < whole.index("say")
    assert spark.range(1).select(records.export_name(F.lit("json"), F.lit("77"), F.lit(3)).alias("n")).first()["n"] == "json-77-3"


def test_cache(spark, tmp_path):
    store = cache.ResultCache(spark, str(tmp_path / "cache"))
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert store.split(keys)[0] is None
    store.put(spark.createDataFrame([("a", 1)], "key string, v int"))
    store.put(spark.createDataFrame([("a", 2)], "key string, v int"))
    hits, misses = store.split(keys)
    assert [(r["key"], r["v"]) for r in hits.collect()] == [("a", 2)] and [r["key"] for r in misses.collect()] == ["b"]
    small = store.compact(str(tmp_path / "small"))
    assert small.read().count() == 1
    store.delete(keys)
    assert store.read().count() == 0
    small.clear()
    assert small.read().count() == 0
    key = lambda o: spark.range(1).select(cache.cache_key(*[F.lit(x) for x in ("m", "p", "u", "c", "s", "fast", o)]).alias("k")).first()["k"]
    assert json.loads(key("{}"))[:6] == ["m", "p", "u", "c", "s", "fast"] and key("{}") != key("{1}")


def test_arrivals(spark, tmp_path):
    frame = spark.range(5).withColumn("v", F.col("id") * 2)
    frame.write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), frame.schema)
    arrivals.evaluate_arrivals(stream, lambda b: b.agg(F.sum("v").alias("s")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("s")).first()[0] == 20


def test_responses(spark):
    body = json.dumps({"predictions": [["甲", 0.5], ["乙", "x"], [1, 2], ["丙", 1]]})
    rows = [(1, body, 200), (2, "{", 200), (3, "{}", 200), (4, json.dumps({"error": "busy"}), 503), (5, "{}", 500)]
    got = {r["i"]: r for r in responses.classified(spark.createDataFrame(rows, "i int, body string, code int"), status="code").collect()}
    assert [tuple(p) for p in got[1]["predictions"]] == [("甲", 0.5), ("丙", 1.0)] and got[1]["error"] is None
    assert [got[i]["error"] for i in (2, 3, 4, 5)] == ["not JSON", "no predictions", "failed: busy", "failed"]
    urls = spark.createDataFrame([("a b",), ("a b",), (None,)], "url string")
    assert [r["u"] for r in responses.distinct_requests(urls).select(responses.viewer_address("https://v/?x=1", F.col("url")).alias("u")).collect()] == ["https://v/?x=1&manifest=a+b"]
    assert responses.presets(spark, [("t", "d", "e", None, "u")]).first()["url"] == "u"
    pages = spark.sql("select 'c' as canvas_id, array(named_struct('region', cast(null as int)), named_struct('region', 5)) as lines")
    assert [tuple(r) for r in responses.regions_of(pages).collect()] == [("c", 1, 5)]
    entries = cache.entry_of(spark.createDataFrame([(1, "v")], "page_id int, v string"), spark.createDataFrame([(1, "k", "m", "c", "s")], "page_id int, key string, manifest_url string, canvas_id string, image_service_id string"))
    assert entries.first()["key"] == "k" and cache.result_of(entries).columns == ["page_id", "v"]
