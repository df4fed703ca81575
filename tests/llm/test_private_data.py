"""Surrogates: nothing private passes, rows equal a plain rewriting, tables at rest are sealed."""

import glob
import random
import re
import string

import pytest

from quire.llm import common, surrogates

SF = "/root/testdata/sf0.001"


def plain_rewrite(texts, key):
    """All texts at once: first attempts, then conflicts until none is left."""
    found = [list(surrogates.entities(t or "")) for t in texts]
    known = {(k, surrogates.canonical(k, s)) for own in found for k, _, _, s in own}
    attempt = dict.fromkeys(known, 0)
    while True:
        now = {x: surrogates.surrogate(*x, key, attempt[x]) for x in known}
        owner = {}
        for k, e in sorted(known, key=lambda x: surrogates.seal(key, x[1])):
            owner.setdefault((k, now[k, e]), e)
        moving = {(k, surrogates.group_of(k, e)) for k, e in known if (k, now[k, e]) in known or owner[k, now[k, e]] != e}
        if not moving:
            break
        for k, e in known:
            attempt[k, e] += (k, surrogates.group_of(k, e)) in moving
    out = []
    for t, own in zip(texts, found, strict=True):
        new, at = "", 0
        for k, a, b, said in own:
            new += t[at:a] + surrogates.written_like(k, said, now[k, surrogates.canonical(k, said)])
            at = b
        out.append(new + t[at:] if own else t)
    return out


CROWDED = [f"Mr {a}{b} or Mr John {a}{b}" for a in "BCDF" for b in "aeiouy"] + [f"{c}@x.org" for c in "aeiouy"] + ["Mr Ññ called.", "Frau Ñç", "call +1 22 33", "call +1 22 34", "ssn 123-45-6789"]


def test_rows_equal_a_plain_rewriting(spark):
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for texts in (real, CROWDED, [None, "", "x" * 200_000, "a@b.org " * 2000]):
        docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
        got = [r["private"]["text"] for r in sorted(surrogates.replace(docs, b"k").collect(), key=lambda r: r["i"])]
        assert got == plain_rewrite(texts, b"k")


MORE = [
    ("Mr Ññ called.", "Ññ"), ("Mrs Smith-Jones left", "Jones"), ("Mr O'Brien", "Brien"), ("Dr McDonald", "Donald"), ("saw Jane Doe today", "Doe"), ("My name is Zed Quux.\nBye", "Quux"),
    ("Regards,\nZoë Quimby", "Quimby"), ("mail josé.pérez@example.org", "pérez"), ("mail 田中@例え.jp now", "田中"), ("mail иван@пример.рф", "иван"), ("Г-жа Подъячева", "Подъячева"), ("Κυρία Μαΐου", "Μαΐου"),
    ("Dear Prof Anna Quimby", "Quimby"),
]


@pytest.mark.parametrize(("text", "private"), MORE)
def test_nothing_leaves_unchanged(spark, text, private):
    (row,) = surrogates.replace(spark.createDataFrame([(1, text)], "i int, text string"), b"k").collect()
    assert private not in row["private"]["text"] and row["private"]["spans"]


def test_no_entity_occurs_in_the_output(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        name = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 3)))
        texts.append(rng.choice([f"{name}@a.org", f"+1 {rng.randint(10, 99)} {rng.randint(10, 40)}", f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", f"10.{rng.randint(0, 9)}.0.{rng.randint(0, 9)}", f"Ms {name.capitalize()}a"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["private"]["text"] for r in sorted(surrogates.replace(docs, b"secret").collect(), key=lambda r: r["i"])]
    assert not set(got) & set(texts) and len(set(got)) == len(set(texts))


def test_tables_at_rest_hold_no_entity(spark):
    folder = common.scratch_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/quire/*"))
    docs = spark.createDataFrame([(i, f"Mr {a}{b}, mail {a}{b}@unmistakable.org") for i, (a, b) in enumerate((x, y) for x in "BCDFGHJKLM" for y in "aeiouy")], "i int, text string")
    out = surrogates.replace(docs, b"k")
    left = set(glob.glob(f"{folder}/quire/*")) - before
    assert all(re.search("/exceptions-", x) for x in left) and len(left) <= 1
    for f in (f for x in left for f in glob.glob(f"{x}/*.parquet")):
        assert "unmistakable" not in open(f, "rb").read().decode("latin1")
    assert out.count() == 60


@pytest.mark.parametrize("text", ["", "é", "Ivan|Иван", "x" * 500])
def test_sealing(text):
    sealed = surrogates.seal(b"k", text)
    assert surrogates.unseal(b"k", sealed) == text and sealed == surrogates.seal(b"k", text) != surrogates.seal(b"other", text)
