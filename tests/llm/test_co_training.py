"""Co-training over a table against the same training over arrays, and draws from the whole pool."""

import numpy as np
import pytest

from quire.llm import classify, common

SF = "/root/testdata/sf0.001"


def pages(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    content = np.column_stack((rng.normal(size=(n, classify._CONTENT - 1)) * 0.3 + y[:, None] * 0.5, rng.random(n))).astype(np.float32).astype(float)
    meta = np.column_stack((rng.integers(0, 5, n), np.where(rng.random(n) < 0.9, y, 1 - y), rng.normal(size=n))).astype(np.float32).astype(float)
    return content, meta, y


@pytest.mark.parametrize("gifts", [20, 1000])
def test_a_table_gives_the_model_that_arrays_give(spark, gifts):
    content, meta, y = pages(3000, 1)
    label = np.where(np.arange(3000) < 400, y, -1)
    linear = classify._CONTENT - classify.WORDS
    want = classify.co_train(content, meta, label, gifts=gifts, linear=linear)
    rows = [(list(map(float, r)),) for r in np.column_stack((content, meta))[400:]]
    pool = common.written(spark.createDataFrame(rows, "x array<float>").repartition(7), "p")
    got = classify.co_train(content[:400], meta[:400], label[:400], classify.spark_pool(pool), gifts=gifts, linear=linear)
    assert got.exchanged == want.exchanged > 0
    for a, b in zip(got.scores(content, meta), want.scores(content, meta), strict=True):
        assert np.allclose(a, b, atol=1e-6)


def test_every_page_of_the_pool_can_be_drawn():
    content, meta, y = pages(2000, 2)
    label = np.where(np.arange(2000) < 200, y, -1)
    seen = []

    def draw(views, turn, most, confident):
        out = local(views, turn, most, confident)
        seen.append(out)
        return out

    local = classify.local_pool(content[200:], meta[200:])
    classify.co_train(content[:200], meta[:200], label[:200], draw, gifts=10**6)
    first = seen[0]
    assert len(seen) == 4 and len(first) > 500
    assert len({(v, c.tobytes()) for out in seen for v, _, c, _ in out}) == sum(map(len, seen))  # nothing is given twice


def test_pool_is_all_pages_without_a_label(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sizes = []
    real = classify.spark_pool
    monkeypatch.setattr(classify, "spark_pool", lambda pool: (sizes.append(pool.count()), real(pool))[1])
    classify.fit(docs, labels)
    assert sizes == [docs.join(labels, "doc_id", "left_anti").count()]


def test_words_are_part_of_the_content_view():
    import pyarrow as pa

    a, b = classify.content_values(pa.array(["one two three", "four five six"], pa.large_string()))
    assert len(a) == classify._CONTENT and (a[-classify.WORDS :] != b[-classify.WORDS :]).any()
    assert np.allclose((a[-classify.WORDS :] ** 2).sum(), 1)
