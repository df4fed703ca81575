"""The registered query of order 3 against brute force."""

import random

import numpy as np
import pytest

import __spark_entry__
from quire.llm import lm_score
from test_operators import SF, brute_scores


def test_the_trigram_query_takes_both_steps_back(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, brute_scores([r["text"] for r in rows], 3), strict=True)}
    got = __spark_entry__.queries()["lm_scoring_trigrams"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        n, back, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_backoff"]) == (n, back) and abs(r["score_micro"] - score) <= n


@pytest.mark.parametrize("fan", [2, 3])
def test_counts_on_their_way_over_several_levels(spark, fan):
    rng = random.Random(fan)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 60))) for _ in range(120)] * 2 + [None, "a b c " * 400]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Text_Key string").repartition(3)
    out = lm_score.stupid_backoff(docs, order=3, block_bytes=1500, partition_bytes=700, fan=fan)
    assert out.columns == ["doc_id", "text", "Text_Key", "n_tokens", "n_backoff", "score_micro"]
    want = brute_scores(texts, 3)
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, back, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_backoff"]) == (n, back) and abs(r["score_micro"] - score) <= n


def test_rows_that_a_block_sends_are_bounded():
    part = np.sort(np.random.default_rng(1).integers(0, 10_000, 50_000))
    out = {c: [] for c in lm_score._ASKED.names}
    lm_score._send(part, np.arange(50_000, dtype=np.uint64), np.ones(50_000, np.int64), -(-10_000 // 8), 1, 0, 0, out)
    assert len(out["bucket"]) == 8


def test_many_equal_rows_are_scored_once(spark):
    docs = spark.range(30_000).selectExpr("id doc_id", "if(id < 29000, 'the same text again', concat('text ', id)) text")
    rows = lm_score.stupid_backoff(docs, order=3).where("doc_id < 29000").select("n_tokens", "n_backoff", "score_micro").distinct().collect()
    assert len(rows) == 1 and rows[0]["n_backoff"] == 0
