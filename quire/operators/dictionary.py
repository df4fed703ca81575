"""Variant characters: normalising texts with a dictionary of pairs, and looking entries up.

A dictionary is a table (entry_idx, normalized, variants array), in order. It is small by nature (thousands of pairs);
:func:`resolve` refuses one that is not, so what is broadcast or folded into an expression is bounded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from quire.functions.text import trim

#: Pairs that a dictionary may have.
MOST_PAIRS = 20_000


def pairs(entries: DataFrame) -> DataFrame:
    """Replacement pairs in the order of application: longest variant first, then dictionary order."""
    rows = entries.select("entry_idx", "normalized", F.posexplode("variants").alias("variant_idx", "variant")).where(F.col("variant") != F.col("normalized"))
    return rows.orderBy(-F.length("variant"), "entry_idx", "variant_idx")


def resolve(entries: DataFrame) -> list[tuple[str, str]]:
    """The ordered pairs on the driver, bounded by ``MOST_PAIRS``."""
    got = [(r["variant"], r["normalized"]) for r in pairs(entries).limit(MOST_PAIRS + 1).collect()]
    if len(got) > MOST_PAIRS:
        raise ValueError(f"a dictionary of over {MOST_PAIRS} pairs")
    return got


def normalize(text: Column, ordered: list[tuple[str, str]]) -> Column:
    """Replace variants one pair after another, as a rule list does: later pairs see what earlier ones wrote.

    Multi-character variants stay single replacements in order. The single-character tail of the list folds into one
    ``translate`` over characters that are resolved through the rest of the list, if its results are single characters.
    """
    wide = [p for p in ordered if len(p[0]) != 1]
    tail = [p for p in ordered if len(p[0]) == 1]
    for variant, target in wide:
        text = F.replace(text, F.lit(variant), F.lit(target))
    if all(len(t) == 1 for _, t in tail):
        # a character maps to what the pairs after its own make of it; an earlier pair of the same variant wins
        first: dict[str, str] = {}
        after: dict[str, str] = {}
        for variant, target in reversed(tail):
            first[variant] = after.get(target, target)
            after[variant] = first[variant]
        return F.translate(text, "".join(first), "".join(first.values())) if first else text
    for variant, target in tail:
        text = F.replace(text, F.lit(variant), F.lit(target))
    return text


def terms_of(entries: DataFrame) -> list[tuple[int, str, list[str]]]:
    """All entries with their terms on the driver; entries and terms are bounded by ``MOST_PAIRS``."""
    words = F.array_distinct(F.concat(F.array("normalized"), F.coalesce("variants", F.array())))
    listed = entries.select("entry_idx", "normalized", F.filter(words, lambda w: w != "").alias("terms"))
    n = listed.agg(F.greatest(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0)))).first()[0]
    if n > MOST_PAIRS:
        raise ValueError(f"a dictionary of {n} terms; at most {MOST_PAIRS} fit a search")
    return sorted((r["entry_idx"], r["normalized"], r["terms"]) for r in listed.collect())


def search(texts: DataFrame, entries: DataFrame, key: str, text: str = "text", fold: bool = True) -> DataFrame:
    """Entries that occur in each text: key, entry_idx, normalized, position (from 0), rank.

    An entry's position is the first of any of its terms, in the trimmed text or (``fold``) its compatibility form. Order:
    position, then the entry by Japanese collation, then dictionary order. A blank text finds every entry, in dictionary
    order. The dictionary is bounded (see :data:`MOST_PAIRS`); each text is read in one pass over batches, and only for
    terms that begin with one of its characters.
    """
    listed = terms_of(entries)
    kind = entries.schema["entry_idx"].dataType
    shape = T.ArrayType(T.StructType([T.StructField("entry_idx", kind), T.StructField("normalized", T.StringType()), T.StructField("position", T.IntegerType())]))

    @arrow_udf(shape)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        heads: dict[str, list[tuple[int, str]]] = {}
        for at, (_, _, terms) in enumerate(listed):
            for term in terms:
                heads.setdefault(term[0], []).append((at, term))
        for column in batches:
            out = []
            for t in column.to_pylist():
                first = dict.fromkeys(range(len(listed)), -1) if t == "" else {}
                for form in dict.fromkeys((t, unicodedata.normalize("NFKC", t)) if fold else (t,)) if t else ():
                    for c in heads.keys() & set(form):
                        for at, term in heads[c]:
                            place = form.find(term, 0, first[at] + len(term)) if at in first else form.find(term)
                            if place >= 0 and place < first.get(at, place + 1):
                                first[at] = place
                out.append([{"entry_idx": listed[at][0], "normalized": listed[at][1], "position": p} for at, p in first.items()])
            yield pa.array(out, to_arrow_type(shape))

    shown = texts.select(key, trim(F.coalesce(text, F.lit(""))).alias("t"))
    found = shown.select(key, F.inline(find("t")))
    order = Window.partitionBy(key).orderBy("position", F.when(F.col("position") >= 0, F.collate("normalized", "ja")), "entry_idx")
    return found.withColumn("rank", F.row_number().over(order) - 1)


def page_of_results(found: DataFrame, shown: int = 120) -> DataFrame:
    """The first ``shown`` results of each text."""
    return found.where(F.col("rank") < shown)
