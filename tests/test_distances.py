"""Distances of long texts and the bounded test against a plain table."""

import random

from pyspark.sql import functions as F

from quire.functions import text


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs():
    rng = random.Random(7)
    out = [("", ""), ("", "a"), ("a", ""), ("😀b", "b😀"), ("same", "same"), ("é" * 300, "e" * 310)]
    for n in (1, 2, 9, 63, 64, 65, 128, 300, 420):
        a = "".join(rng.choice("abcdeé😀文 \n") for _ in range(n))
        b = "".join(c for c in a if rng.random() > 0.1) + "tail"
        out += [(a, b), (b, a), (a, a[::-1]), ("x" + a, a), (a, "".join(rng.choice("abcde") for _ in range(n)))]
    return out


def test_bit_columns_equal_the_table():
    for a, b in pairs():
        assert text.edits(a, b) == distance(a, b)


def test_columns(spark):
    rows = [(i, a, b, k) for i, (a, b) in enumerate(pairs()) for k in (0, 1, 40)] + [(-1, None, "a", 1), (-2, "a", None, 1), (-3, None, None, 1)]
    frame = spark.createDataFrame(rows, "i int, a string, b string, k int")
    got = frame.select("a", "b", "k", text.text_distance(F.col("a"), F.col("b")).alias("d"), text.within(F.col("a"), F.col("b"), F.col("k")).alias("w")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.a is None or r.b is None:
            assert r.d is None and r.w is None
        else:
            want = distance(r.a, r.b)
            assert (r.d, r.w) == (want, want <= r.k)
