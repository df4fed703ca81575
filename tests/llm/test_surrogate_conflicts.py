"""Surrogates of a format that the corpus uses up."""

import re

from quire.llm import surrogates


def test_used_up_formats_stay_distinct_and_names_agree(spark):
    last = [f"{a}{b}" for a in "BCDFGHJKLMNPQRSTVWXZ" for b in "aeiouy"]
    texts = [f"Mr {x} or Mr John {x}" for x in last] + [f"{c}@x.org" for c in "aeiouy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["private"]["text"] for r in sorted(surrogates.replace(docs, b"k").collect())]
    names = [re.fullmatch(r"Mr (\w+) or Mr \w+ (\w+)", t).groups() for t in got[: len(last)]]
    assert all(a == b for a, b in names)
    assert len({a for a, _ in names}) == len(last) and not {a for a, _ in names} & set(last)
    assert len(set(got[len(last) :])) == 6 and not set(got) & set(texts)
