"""The pipeline's stages, one after another, against brute force on the smallest tables."""

import re
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quire.llm import rules, simhash
from test_operators import brute_base, brute_counts, words_of
from test_resemblance import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)

    ruled = stages[names[0]](spark, docs, SF)
    assert ruled.columns == docs.columns
    ruled = {r["doc_id"]: r for r in ruled.collect()}
    verdicts = {r["doc_id"]: r["rules"] for r in rules.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    for i, r in rows.items():
        n, _, _, _, repeats = brute_counts(r["text"])
        assert not (i in ruled and (n < 50 or 100 * repeats > 50 * n))
        assert (i in ruled) == verdicts[i]["kept"]

    frame = spark.createDataFrame(list(ruled.values()), docs.schema)
    good = stages[names[1]](spark, frame, SF)
    assert good.columns == docs.columns
    good = good.collect()
    assert 0 < len(good) <= len(ruled) and all(tuple(r) == tuple(rows[r["doc_id"]]) for r in good)

    good = sorted(good)
    unique = stages[names[2]](spark, spark.createDataFrame(good, docs.schema), SF)
    kept = {r["doc_id"] for r in unique.collect()}
    assert unique.columns == docs.columns and kept == brute_kept([(r["doc_id"], r["text"]) for r in good])

    masked = stages[names[3]](spark, unique, SF)
    assert masked.columns == docs.columns
    masked = masked.collect()
    assert len(masked) == len(kept) and not any(brute_base(r["text"]) for r in masked)
    for r in masked:
        if not brute_base(rows[r["doc_id"]]["text"]) and "[SECRET]" not in r["text"]:
            assert tuple(r) == tuple(rows[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])

    pieces = stages[names[4]](spark, spark.createDataFrame(masked, docs.schema), SF).collect()
    sums = Counter()
    for p in pieces:
        sums[p["doc_id"]] += p["piece_length"]
        assert p["bin_offset"] + p["piece_length"] <= p["bin_used"] <= p["bin_capacity"]
    assert sums == {r["doc_id"]: len(words_of(r["text"])) + 1 for r in masked}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, pieces))


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long_text = " ".join(f"word{i % 997} and the other" for i in range(60))
    extra = [(None, long_text, None, None, None), (5, None, "en", "s", 0), (5, "", "en", "s", 0), (7, long_text, "en", "s", None), (7, long_text, "en", "s", None)]
    odd = spark.createDataFrame(extra, docs.schema)
    for frame in (odd, odd.limit(0), odd.withColumn("kept", F.lit(1)).withColumn("rules", F.lit("x"))):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == frame.columns, name
            now = spark.createDataFrame(now.collect(), now.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count() or now.count() == 0
    assert simhash.one_of_each(odd).count() == 2


def test_entry_lists_every_operator():
    known = __spark_entry__.queries()
    assert "pipeline" in known
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", k)) for k in known) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(known)
