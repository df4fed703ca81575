"""Licence scans by sentence rules.

Each sentence is normalised to its words; runs of words that spell a known licence sentence map to its identifier; and
the sequence of identifiers of a document is matched against ordered licence rules, longest text first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import fresh, text_of

# Known licence sentences after normalisation. ``*`` stands for up to eight words; ``a|b`` for either word.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2-ref": ("licensed under the apache license version 2.0", "licensed under apache license 2.0", "released under the apache license version 2.0", "under the terms of the apache license version 2.0"),
    "apache2-use": ("you may not use this file except in compliance with the license",),
    "apache2-copy": ("you may obtain a copy of the license at",),
    "apache2-warranty": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",),
    "mit-ref": ("released|licensed|distributed under the mit license", "licensed under mit", "released|licensed|distributed under the terms of the mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-warranty": ("the software is provided as is without warranty of any kind",),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice",),
    "bsd-endorse": ("neither the name of * nor the names of its contributors may be used to endorse or promote products",),
    "bsd-warranty": ("this software is provided by * as is and any express or implied warranties",),
    "gpl3-ref": ("licensed under the gnu general public license version 3", "under the terms of the gnu general public license version 3", "licensed under gpl 3.0", "licensed under the gplv3"),
    "gpl2-ref": ("licensed under the gnu general public license version 2", "under the terms of the gnu general public license version 2"),
    "gpl3-or-later": ("either version 3 of the license or at your option any later version",),
    "gpl2-or-later": ("either version 2 of the license or at your option any later version",),
    "gpl-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",),
    "lgpl-ref": ("licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    "agpl3-ref": ("licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license version 3"),
    "mpl2-ref": ("this source code form is subject to the terms of the mozilla public license v|version 2.0", "licensed under the mozilla public license version 2.0"),
    "cc-by-4-ref": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"),
    "cc-by-sa-4-ref": ("licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc-by-nc-4-ref": ("licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc-by-nd-4-ref": ("licensed under cc by nd 4.0", "licensed under a creative commons attribution noderivatives 4.0 international license"),
    "cc0-ref": ("released|licensed under cc0", "to the extent possible under law * has waived all copyright", "dedicated to the public domain"),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "all-rights": ("all rights reserved",),
    "lgpl21-ref": ("licensed under the gnu lesser general public license version 2.1", "under the terms of the gnu lesser general public license version 2.1"),
    "lgpl3-ref": ("licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license version 3"),
    "lgpl-free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",),
    "lgpl21-or-later": ("either version 2.1 of the license or at your option any later version",),
    "gpl-verbatim": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",),
    "gpl2-head": ("gnu general public license version 2 june 1991",),
    "gpl3-head": ("gnu general public license version 3 29 june 2007",),
    "agpl3-head": ("gnu affero general public license version 3 19 november 2007",),
    "lgpl21-head": ("gnu lesser general public license version 2.1 february 1999",),
    "lgpl3-head": ("gnu lesser general public license version 3 29 june 2007",),
    "epl2-ref": ("made available under the terms of the eclipse public license v|version 2.0", "made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license v|version 2.0"),
    "boost-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "boost-ref": ("distributed under the boost software license version 1.0",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications",),
    "zlib-warranty": ("this software is provided as is without any express or implied warranty",),
    "artistic2-ref": ("licensed under the artistic license 2.0", "under the terms of the artistic license version 2.0"),
    "isc-warranty": ("the software is provided as is and the author disclaims all warranties",),
}

# Ordered licence rules; the first rule that matches at a place in the sequence of identifiers wins.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-ref", "apache2-use", "apache2-copy", "apache2-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-0", ("mit-grant", "mit-warranty")),
    ("GPL-2.0", ("gpl2-head", "gpl-verbatim")),
    ("GPL-3.0", ("gpl3-head", "gpl-verbatim")),
    ("AGPL-3.0", ("agpl3-head", "gpl-verbatim")),
    ("LGPL-2.1", ("lgpl21-head", "gpl-verbatim")),
    ("LGPL-3.0", ("lgpl3-head", "gpl-verbatim")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-or-later")),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-or-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-or-later")),
    ("Apache-2.0", ("apache2-ref", "apache2-use")),
    ("Apache-2.0", ("apache2-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-grant",)),
    ("AGPL-3.0", ("agpl3-ref",)),
    ("LGPL-2.1", ("lgpl21-ref",)),
    ("LGPL-3.0", ("lgpl3-ref",)),
    ("LGPL", ("lgpl-ref",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-ref",)),
    ("Artistic-2.0", ("artistic2-ref",)),
    ("GPL-2.0", ("gpl2-head",)),
    ("GPL-3.0", ("gpl3-head",)),
    ("AGPL-3.0", ("agpl3-head",)),
    ("LGPL-2.1", ("lgpl21-head",)),
    ("LGPL-3.0", ("lgpl3-head",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("all-rights",)),
)

WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
SENTENCE_END = re.compile(r"(?<=\.)(?!(?<=\b[Vv]\.)[^\S\n]*\n?[^\w\n]*[0-9])\s+|\n[^\S\n]*\n")
#: A text without any of these (case folded) holds no known sentence. Single words, as line ends and marks may part any two.
HINT = r"(?i)licen[sc]e|permi(?:tted|ssion)|copyright|warrant|redistribut|domain|reserved|endorse|cc0|gpl"
_GAP = 8


def _compiled() -> dict[str, list[tuple[str, list[frozenset[str] | None]]]]:
    """Known sentences by first word, longest first; None stands for a gap."""
    out: dict[str, list] = {}
    for name, forms in SENTENCES.items():
        for form in forms:
            parts = [None if w == "*" else frozenset(w.split("|")) for w in form.split()]
            for first in parts[0]:
                out.setdefault(first, []).append((name, parts))
    for forms in out.values():
        forms.sort(key=lambda x: (-len(x[1]), x[0]))
    return out


def _match(words: list[str], at: int, parts: list[frozenset[str] | None], k: int = 0) -> int:
    """The word after a match of parts[k:] at a place, or -1."""
    while k < len(parts):
        if parts[k] is None:
            for skip in range(_GAP + 1):
                if (end := _match(words, at + skip, parts, k + 1)) >= 0:
                    return end
            return -1
        if at >= len(words) or words[at] not in parts[k]:
            return -1
        at, k = at + 1, k + 1
    return at


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(start, sentence): cut after a full stop with white space (not "v." before a number), and at empty lines; other line ends only wrap."""
    at = 0
    for m in SENTENCE_END.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


def known_sentences(text: str, table: dict | None = None) -> list[tuple[str, int, int]]:
    """Identifiers of the known sentences in order, with their span in code points."""
    table = table or _compiled()
    out = []
    for start, sentence in sentences(text):
        places = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(sentence)]
        words, i = [w for w, _, _ in places], 0
        while i < len(words):
            for name, parts in table.get(words[i], ()):
                end = _match(words, i, parts)
                if end >= 0:
                    out.append((name, start + places[i][1], start + places[end - 1][2]))
                    i = end - 1
                    break
            i += 1
    return out


#: Other known sentences that may stand between two sentences of a rule.
BETWEEN = 3


def apply_rules(found: list[tuple[str, int, int]]) -> tuple[list[tuple[str, int, int]], int]:
    """Licences with their spans, in order of their first sentence, and the number of sentences that no rule took.

    At each sentence that is not taken yet, the first rule whose identifiers follow in order takes them, with up to
    ``BETWEEN`` others between any two. Those between are left for other rules.
    """
    out, free = [], [True] * len(found)

    def places(at: int, rule: tuple[str, ...]) -> list[int] | None:
        own = []
        for name in rule:
            near = range(at, min(len(found), at + (BETWEEN if own else 0) + 1))
            if (at := next((k for k in near if free[k] and found[k][0] == name), -1)) < 0:
                return None
            own.append(at)
            at += 1
        return own

    for i in range(len(found)):
        if free[i]:
            for licence, rule in RULES:
                if own := places(i, rule):
                    out.append((licence, found[i][1], found[own[-1]][2]))
                    for k in own:
                        free[k] = False
                    break
    return out, sum(free)


SPAN = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SCANNED = T.StructType([T.StructField("licences", T.ArrayType(SPAN)), T.StructField("sentences", T.ArrayType(SPAN)), T.StructField("n_unmatched", T.IntegerType())])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``licences`` (another name if taken): licences and known sentences with spans.

    Whole texts are read. Null texts count as empty: empty arrays. Rows repeat as in ``docs``; an empty table gives an
    empty table.
    """
    from .telephony import to_arrow

    @arrow_udf(SCANNED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, kind = _compiled(), to_arrow(SCANNED)
        spans = lambda xs: [{"name": n, "start": a, "end": b} for n, a, b in xs]
        nothing = {"licences": [], "sentences": [], "n_unmatched": 0}
        for texts in batches:
            hint = pc.match_substring_regex(texts, HINT).to_pylist()
            out = []
            for i, likely in enumerate(hint):
                found = known_sentences(texts[i].as_py(), table) if likely else []
                if not found:
                    out.append(nothing)
                    continue
                licences, left = apply_rules(found)
                out.append({"licences": spans(licences), "sentences": spans(found), "n_unmatched": left})
            yield pa.array(out, kind)

    (name,) = fresh(docs, "licences")
    return docs.withColumn(name, run(text_of(text)))
