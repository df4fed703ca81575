"""Every known licence sentence, however it is wrapped."""

import pytest

from quire.llm import licences

FORMS = [(n, f.replace("*", "some words").replace("|", " ").split()) for n, fs in licences.SENTENCES.items() for f in fs if "|" not in f]
FORMS += [(n, [w.split("|")[k] if "|" in w else w for w in f.replace("*", "some words").split()]) for n, fs in licences.SENTENCES.items() for f in fs if "|" in f for k in (0, 1)]


@pytest.mark.parametrize("between", [" ", "  ", "\n", "\n * ", "\t"])
def test_wrapped_forms_are_found_by_the_scan(spark, between):
    texts = [between.join(ws) for _, ws in FORMS]
    rows = sorted(licences.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect())
    for r, text in zip(rows, texts, strict=True):
        assert [s["name"] for s in r["licences"]["sentences"]] == [n for n, _, _ in licences.known_sentences(text)] != []


MPL = "This Source Code Form is subject to the terms of the Mozilla Public{0}License, v.{0}2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
GPL = (
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation; either version {0} of the License, or\n(at your option) any later version.\n"
)


@pytest.mark.parametrize(
    ("text", "want"),
    [(MPL.format(" "), "MPL-2.0"), (MPL.format("\n"), "MPL-2.0"), (MPL.format("\n * "), "MPL-2.0"), (GPL.format(2), "GPL-2.0-or-later"), (GPL.format(3), "GPL-3.0-or-later")],
)
def test_standard_headers(text, want):
    assert [n for n, _, _ in licences.apply_rules(licences.known_sentences(text))[0]] == [want]


def test_v_ends_a_sentence_before_other_words():
    assert len(list(licences.sentences("As in part v. Other words. More"))) == 3
    assert len(list(licences.sentences("Licence, v.\n\n2 is next"))) == 2


def brute_scan(text):
    """Every form tried at every word of every sentence, longest first, without any filter; rules as written down."""
    import re

    found = []
    for start, sentence in licences.sentences(text):
        places = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+(?:\.[0-9]+)*", sentence)]
        i = 0
        while i < len(places):
            best = None
            for name, forms in licences.SENTENCES.items():
                for form in forms:
                    pattern = "".join(r"(?:\S+ ){0,8}?" if w == "*" else f"(?:{'|'.join(map(re.escape, w.split('|')))}) " for w in form.split())
                    if m := re.match(pattern, "".join(w + " " for w, _, _ in places[i : i + 60])):
                        key = (-len(form.split()), name)
                        if best is None or key < best[0]:
                            best = (key, name, m.group().count(" "))
            if best:
                found.append((best[1], start + places[i][1], start + places[i + best[2] - 1][2]))
                i += best[2]
            else:
                i += 1
    return found


def test_scan_equals_a_search_without_a_filter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-1, MPL.format("\n")), (-2, GPL.format(2)), (-3, None), (-4, "word " * 30_000 + "all rights\nreserved"), (-5, ". " * 3000)], "doc_id long, text string")
    checked = 0
    for r in licences.scan(docs.select("doc_id", "text").unionByName(extra)).collect():
        words = (r["text"] or "").split()
        if len(words) < 700 or r["doc_id"] < 0:
            want = brute_scan(r["text"] or "") if r["doc_id"] != -4 else [("all-rights", len(r["text"]) - 19, len(r["text"]))]
            assert [(s["name"], s["start"], s["end"]) for s in r["licences"]["sentences"]] == want
            assert [(s["name"], s["start"], s["end"]) for s in r["licences"]["licences"]] == licences.apply_rules(want)[0]
            checked += 1
    assert checked > 50


def test_rules_leave_other_sentences_to_others():
    at = lambda *names: [(n, 10 * i, 10 * i + 5) for i, n in enumerate(names)]
    assert licences.apply_rules(at("mit-grant", "all-rights", "mit-notice", "mit-warranty")) == ([("MIT", 0, 35), ("Proprietary", 10, 15)], 0)
    assert licences.apply_rules(at("mit-grant", "mit-warranty")) == ([("MIT-0", 0, 15)], 0)
    assert licences.apply_rules(at("apache2-copy", "gpl3-head", "gpl-verbatim")) == ([("GPL-3.0", 10, 25)], 1)
    assert licences.apply_rules([]) == ([], 0)
