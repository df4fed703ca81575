"""The pipeline's near-copy stage against brute force over exact shingle sets."""

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import common, graph, resemblance

SF = "/root/testdata/sf0.001"


def brute_kept(rows, least=0.8):
    """Smallest id of each group, by all pairs."""
    rows = sorted(rows)
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {rows[root(i)][0] for i in range(len(rows))}


def test_near_copies_of_the_stage_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SF).collect()}
    assert got == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize(("rounds", "most"), [(0, 4096), (2, 4096), (0, 8), (2, 8)])
def test_every_pair_of_a_bucket_is_verified(spark, rounds, most):
    # one bucket: a chain of sets of similarity 0.82, and sets that are like no other
    sets = [(i, list(range(10 * i, 10 * i + 100))) for i in range(30)] + [(100 + i, list(range(10_000 * (i + 1), 10_000 * (i + 1) + 100))) for i in range(20)]
    own = common.written(spark.createDataFrame(sets, "node long, own array<long>"), "t")
    buckets = own.selectExpr("1L key", "node", "100L n")
    found = resemblance.links(buckets, own, 80, rounds, most_sets=most)
    got = {r["node"]: r["label"] for r in graph.connected_components(found).collect()}
    assert got == {i: 0 for i in range(30)}


def brute_links(sets, least=80):
    return {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (b := len(set(sets[i]) & set(sets[j]))) >= least * (len(sets[i]) + len(sets[j]) - b)}


def test_links_of_a_group_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    for turn in range(40):
        core = [np.sort(rng.choice(400, rng.integers(1, 120), replace=False)) for _ in range(3)]
        own = []
        for _ in range(int(rng.integers(2, 40))):
            c = core[rng.integers(3)]
            own.append(np.unique(np.concatenate((c[rng.random(len(c)) < 0.93], rng.integers(1000, 1100, rng.integers(0, 6)), [5000 + len(own)] * (turn % 2)))))
        own = [x if len(x) else np.array([9999]) for x in own]
        got = resemblance.linked(own, np.arange(len(own)), 80)
        pairs = brute_links([x.tolist() for x in own])
        assert {(max(p), min(p)) for p in got} <= pairs
        assert joined(len(own), got) == joined(len(own), pairs)


def joined(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_groups_beyond_the_bound_are_verified_bucket_by_bucket(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(resemblance.components, "__defaults__", (80, 2, 1000))
    got = {r["doc_id"] for r in resemblance.one_of_each(docs).collect()}
    assert got == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_rows_that_only_differ_in_nulls_stay_apart(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, words, "x", None), (None, words, None, "x"), (None, other, "x", None), (None, other, "x", None), (4, None, None, None), (3, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, label string")
    got = resemblance.one_of_each(docs)
    assert got.columns == docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 3 and (3, "", None, None) in rows and (None, other, "x", None) in rows
    assert resemblance.one_of_each(docs.limit(0)).count() == 0
