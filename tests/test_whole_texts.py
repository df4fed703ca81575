"""The queries over whole texts and lines against brute force on a small table of other languages and long texts."""

import pytest

from quire.queries import QUERIES

TEXTS = [
    "Überall " * 20 + "Ende\nzweite Zeile é", "the same words " * 9 + "and 😀 more", None, "", "Вера и Иван\n\nеще строка", "ascii only, but longer than forty characters, to the end",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("whole")
    rows = [(i, t, [None, "en", "de", "ru"][i % 4], "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return str(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fnv(t):
    h, raw = 2166136261, t.encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619) & 0xFFFFFFFF
    return f"{h:08x}"


def run(spark, folder, name, keys):
    return {tuple(r[:keys]): tuple(r[keys:]) for r in QUERIES[name](spark, folder).collect()}


def test_whole_texts(spark, folder):
    t = [x or "" for x in TEXTS]
    d = [distance(a, b) for a, b in zip(t, t[1:])]
    assert run(spark, folder, "edit_distance", 1) == {(i,): (x,) for i, x in enumerate(d)}
    assert run(spark, folder, "edit_distance_norm", 1) == {(i,): (round(x / (max(len(t[i]), len(t[i + 1])) or 1), 6),) for i, x in enumerate(d)}
    assert run(spark, folder, "cer", 1) == {(i,): (round(x / len(t[i]), 6) if t[i] else float(bool(t[i + 1])),) for i, x in enumerate(d)}
    assert run(spark, folder, "cache_key_hash", 1) == {(i,): (fnv(x),) for i, x in enumerate(t)}
    assert len(run(spark, folder, "segment_merge", 1)) == len(t)


def test_whole_lines(spark, folder):
    lines = {(i, k): x for i, t in enumerate(TEXTS) for k, x in enumerate((t or "").split("\n"))}
    for name in ("low_confidence", "candidate_utility"):
        assert set(run(spark, folder, name, 3)) == {(*k, o) for k in lines for o in range(3)}
    for name in ("candidate_consensus", "strategy_compare"):
        assert set(run(spark, folder, name, 2)) == set(lines)
    top = run(spark, folder, "candidate_top_score", 2)
    for (i, k), x in lines.items():
        read = [x, x.translate(str.maketrans("eéио", "cèнe")), x + "~"]
        best = max(range(3), key=lambda o: ((len(read[o]) + i) % 89, -o))
        assert top[i, k] == (best, read[best])
