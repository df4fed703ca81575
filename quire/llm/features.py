"""Counts of a text that quality rules and classifiers look at, computed for a batch of texts at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import flat_words, slices, text_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio", "digit_ratio", "stop_ratio", "mark_ratio", "mean_word", "distinct_ratio", "line_words", "wide_ratio")
SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in RATIOS])

#: The blank characters of the word rule.
BLANK = " \t\n\v\f\r"
_LEAD, _WORD, _SYMBOL, _UPPER, _DIGIT, _STOP, _MARKS, _WIDE = (1 << i for i in range(8))


def _classes() -> np.ndarray:
    flags = np.zeros(256, np.uint8)
    flags[[b for b in range(256) if b & 0xC0 != 0x80]] |= _LEAD
    flags[[b for b in range(256) if chr(b) not in BLANK and b & 0xC0 != 0x80]] |= _WORD
    for chars, flag in (("#*$%&|<>", _SYMBOL), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (".,;:", _STOP), ("!?+=_~^@", _MARKS)):
        flags[[ord(c) for c in chars]] |= flag
    flags[0xC0:] |= _WIDE
    return flags


CLASSES = _classes()


def repeated_words(codes: np.ndarray, kinds: int, sizes: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found twice or more in the text. Exact: no hashing of windows."""
    n = len(codes)
    out = np.zeros(len(sizes), np.int64)
    if n < 3:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    codes = codes.astype(np.int64)
    if kinds < 1 << 20:
        key = (codes[at] * kinds + codes[at + 1]) * kinds + codes[at + 2]
    else:
        pair = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)[1]
        key = pair[at] * np.int64(kinds) + codes[at + 2]
    order = np.lexsort((key, doc[at]))
    k, d = key[order], doc[at][order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    marked = np.zeros(n, bool)
    first = at[order[again]]
    for j in range(3):
        marked[first + j] = True
    np.add.at(out, doc[marked], 1)
    return out


def describe(texts: pa.Array, words: int = 0) -> dict[str, np.ndarray]:
    """All counts and ratios of a batch of texts without nulls; ``word_shares``: the share of each of ``words`` buckets of
    hashed words (A-Z in lower case) among the words of a text."""
    texts = texts.cast(pa.large_string())
    flat, sizes = flat_words(texts)
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    codes = np.asarray(coded.indices)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    distinct = np.zeros(len(sizes), np.int64)
    if len(codes):
        np.add.at(distinct, np.unique(doc.astype(np.int64) * len(coded.dictionary) + codes) // len(coded.dictionary), 1)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    flags = CLASSES[raw]

    def total(flag: int) -> np.ndarray:
        ends = np.concatenate(([0], np.cumsum((flags & flag) != 0)))
        return ends[offsets[1:]] - ends[offsets[:-1]]

    lines, dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts.to_pylist()):
        own = [x for x in t.split("\n") if x.strip(BLANK)]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    chars, symbols, repeats = total(_WORD), total(_SYMBOL), repeated_words(codes, len(coded.dictionary), sizes)
    some, per = np.maximum(sizes, 1), np.maximum(chars, 1)
    shares = np.zeros((len(sizes), words))
    if words and len(codes):
        bucket = np.fromiter((zlib.crc32(w) % words for w in pc.ascii_lower(coded.dictionary).cast(pa.large_binary()).to_pylist()), np.int64, len(coded.dictionary))
        shares = np.bincount(doc * words + bucket[codes], minlength=len(sizes) * words).reshape(-1, words) / some[:, None]
    return {
        "word_shares": shares,
        "n_words": sizes, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats,
        "symbol_ratio": symbols / some, "repeat_ratio": repeats / some, "dup_line_ratio": dup / np.maximum(lines, 1), "upper_ratio": total(_UPPER) / per,
        "digit_ratio": total(_DIGIT) / per, "stop_ratio": total(_STOP) / some, "mark_ratio": total(_MARKS) / some, "mean_word": chars / some,
        "distinct_ratio": distinct / some, "line_words": sizes / np.maximum(lines, 1), "wide_ratio": total(_WIDE) / per,
    }


def features(text: str = "text"):
    """A Column: the struct of all counts and ratios of a text; null counts as empty."""

    @arrow_udf(SCHEMA)
    def text_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for part in slices(texts, 4 << 20):
                got = describe(part)
                parts.append(pa.StructArray.from_arrays([pa.array(got[c], pa.int64() if c in COUNTS else pa.float64()) for c in (*COUNTS, *RATIOS)], [*COUNTS, *RATIOS]))
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], pa.int64() if c in COUNTS else pa.float64()) for c in (*COUNTS, *RATIOS)], [*COUNTS, *RATIOS])

    return text_features(text_of(text))


def labelled(labels: DataFrame, rows: int, label: str = "quality", doc_id: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids, those of the smallest hash: ``doc_id``, ``label`` (0 or 1).

    Ids with a null or another label, or with both labels, are left out; repeated rows count once.
    """
    agreed = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
    return agreed.where("label = other").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows).select("doc_id", F.col("label").cast("int"))
