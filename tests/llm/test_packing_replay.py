"""Best-fit packing against a plain version that places one piece after another."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import packing


def replay(items, caps, cost):
    """Bins of a plain best fit, decreasing, first opened first; each bin a list of pieces."""
    items = sorted(items, reverse=True)
    bins, room = [], []
    for k, s in enumerate(items):
        fits = [b for b in range(len(bins)) if room[b] >= s]
        if not fits:
            left = items[k:]

            def rate(c, left=left, s=s):
                # equal pieces first, then the tokens of smaller ones that are short enough for the rest
                own = min(c // s, left.count(s)) * s
                return cost(c) / (own + min(c - own, sum(x for x in left if x < s and x <= c - own)))

            c = min((c for c in caps if c >= s), key=lambda c: (rate(c), c))
            # the bin size chosen holds for as many bins as these equal pieces fill
            opened = max(1, left.count(s) // (c // s))
            for _ in range(opened):
                bins.append([])
                room.append(c)
            fits = [len(bins) - opened]
        best = min(fits, key=lambda b: (room[b], b))
        bins[best].append(s)
        room[best] -= s
    return bins


def test_layout_equals_the_plain_version():
    rng = random.Random(9)
    for turn in range(150):
        caps = rng.choice([(8, 16, 32), (10, 25), (7,), (5, 6, 40)])
        items = [rng.choice([1, 2, 3, rng.randint(1, max(caps))]) for _ in range(rng.randint(1, 60))]
        layout = packing.best_fit(dict(Counter(items)), caps, packing.linear_cost)
        got = {}
        for s, lo, hi, first, per, _ in layout.places:
            for r in range(lo, hi):
                got.setdefault(first + (r - lo) // per, []).append(s)
        want = [sorted(b) for b in replay(items, caps, packing.linear_cost) if b]
        assert sorted(sorted(b) for b in got.values()) == sorted(want), (turn, caps, items)


def test_columns_that_clash_and_equal_rows(spark):
    rows = [(1, "a b c", "p")] * 3000 + [(None, "a b", None), (2, "c d e f", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Piece string").repartition(5)
    out = packing.pack(docs, packing.word_length(), keep=("doc_id", "Piece"), capacities=(8, 16))
    assert out.columns == ["doc_id", "Piece", "piece1", "piece_start", "piece_length", "bin_id", "bin_offset", "bin_used", "bin_capacity"]
    got = out.collect()
    assert Counter(tuple(r)[:2] for r in got) == {(1, "p"): 3000, (None, None): 1, (2, "q"): 1}
    again = packing.pack(docs.repartition(2).orderBy("doc_id"), packing.word_length(), keep=("doc_id", "Piece"), capacities=(8, 16))
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    used = out.groupBy("bin_id").agg(F.sum("piece_length").alias("s"), F.max("bin_used").alias("u"), F.max(F.col("bin_offset") + F.col("piece_length")).alias("e")).collect()
    assert all(r["s"] == r["u"] == r["e"] for r in used)
    assert max(r["n"] for r in out.where("doc_id = 1").groupBy("bin_id", "bin_offset").agg(F.count("*").alias("n")).collect()) == 1
