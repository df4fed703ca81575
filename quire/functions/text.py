"""Text functions with the semantics that recognition output needs: code points, full Unicode trimming, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# The white space that trimming removes.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def trim(text: Column) -> Column:
    """Trim every Unicode space, the ideographic one included (the built-in trims U+0020 only)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.length(trim(text)) == 0


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over code points, for lines; it can stand in a lambda. Whole texts: :func:`text_distance`."""
    return F.levenshtein(a, b)


#: Texts with at most so many cells in the table of distances are left to the built-in.
CELLS = 65_536


def edits(a: str, b: str) -> int:
    """Levenshtein distance over code points. A column of the table is two integers of one bit per code point (Myers 1999),
    so that time is the product of the lengths over 64 and memory the sum of the lengths."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    n = len(long)
    if not short:
        return n
    codes = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), "<u4")
    places = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(short)}
    every, last = (1 << n) - 1, n - 1
    more, less, distance = every, 0, n  # bits: the next cell below is one higher, one lower
    for c in short:
        same = places[c]
        vertical = same | less
        diagonal = (((same & more) + more) ^ more) | same
        up = less | (every ^ ((diagonal | more) & every))
        down = more & diagonal
        distance += (up >> last & 1) - (down >> last & 1)
        up = up << 1 | 1
        more = (down << 1 | ~(vertical | up)) & every
        less = up & vertical & every
    return distance


@arrow_udf(T.IntegerType())
def _edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else edits(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def text_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over code points, for texts of any length: the built-in for short pairs, bit columns in an Arrow
    function for long ones (it gets nulls for the others). Null if either text is null."""
    short = F.length(a).cast("long") * F.length(b) <= CELLS
    return F.when(short, F.levenshtein(a, b)).otherwise(_edits(F.when(~short, a), F.when(~short, b)))


def within(a: Column, b: Column, limit: Column) -> Column:
    """Whether the edit distance of two lines is at most ``limit`` (int); null if either line is null.

    Unequal lengths bound the distance from below, and code points that differ at equal places bound it from above. The
    table of distances is filled, near its diagonal, only where neither bound decides.
    """
    differing = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean"))
        .when(F.abs(F.length(a) - F.length(b)) > limit, False)
        .when(differing <= limit, True)
        .otherwise(F.call_function("levenshtein", a, b, limit) >= 0)
    )


def normalized_distance(a: Column, b: Column, distance: Callable[[Column, Column], Column] = edit_distance) -> Column:
    """Distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, distance(a, b) / longest).otherwise(F.lit(0.0))


def cer(reference: Column, prediction: Column, distance: Callable[[Column, Column], Column] = edit_distance) -> Column:
    """Character error rate; an empty reference gives 1 for any prediction and 0 for none."""
    n = F.length(reference)
    return F.when(n > 0, distance(reference, prediction) / n).otherwise(F.when(F.length(prediction) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as eight hexadecimal digits."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    # the product of two 32-bit numbers stays below 2^57, so a long holds it
    state = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lower(F.lpad(F.hex(state), 8, "0"))


@arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility composition, which Spark does not have."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


#: Overlap of two pieces is looked for in at most so many code points: a value of the rule, not a shortcut.
OVERLAP = 24


def best_overlap(left: Column, right: Column, longest: int = OVERLAP, tolerance: float = 0.34) -> Column:
    """Length of the best fuzzy overlap of a suffix of ``left`` with a prefix of ``right``; 0 if there is none.

    A single code point must be equal; longer overlaps may differ by ``tolerance`` of their length. The least distance
    wins (differences up to 1e-9 are ties), then the longer overlap.
    """
    most = F.least(F.lit(longest), F.length(left), F.length(right))
    lengths = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.expr("cast(array() as array<int>)"))
    scored = F.transform(lengths, lambda n: F.struct(n.alias("n"), normalized_distance(F.right(left, n), F.left(right, n)).alias("d")))
    allowed = F.filter(scored, lambda s: s["d"] <= F.when(s["n"] == 1, F.lit(0.0)).otherwise(F.lit(tolerance)))
    start = F.struct(F.lit(0).alias("n"), F.lit(9.0).alias("d"))
    better = lambda best, s: (s["d"] < best["d"] - 1e-9) | ((F.abs(s["d"] - best["d"]) <= 1e-9) & (s["n"] > best["n"]))
    return F.aggregate(allowed, start, lambda best, s: F.when(better(best, s), s).otherwise(best), lambda best: best["n"])


def merge_pieces(pieces: Column) -> Column:
    """Join pieces of a line at their overlaps; null for no pieces, or if two non-empty neighbours do not overlap."""

    def step(acc: Column, piece: Column) -> Column:
        n = best_overlap(acc, piece)
        broken = (n == 0) & (F.length(acc) > 0) & (F.length(piece) > 0)
        return F.when(broken, F.lit(None).cast("string")).otherwise(F.concat(acc, F.substring(piece, n + 1, F.length(piece))))

    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when(F.size(pieces) > 0, F.aggregate(rest, F.get(pieces, F.lit(0)), step))


def percent(score: Column) -> Column:
    """A share as whole percent, a dash for null."""
    return F.when(score.isNull(), F.lit("—")).otherwise(F.concat(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) * 100 + 0.5).cast("string"), F.lit("%")))
