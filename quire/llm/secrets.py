"""Secret scans with DataFrame expressions only.

Rules find assignments, access keys and long hexadecimal runs. Beyond them, each remaining token is judged by two
character Markov models, one of random strings and one of ordinary identifiers, trained from labelled samples: the log-
likelihood ratio of its character pairs, per pair and in total, says whether it is a secret.

Positions are found without Python: ``split`` gives what lies between the matches of a pattern, so running sums of
lengths give the span of each match in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, text_of

# Fixed patterns of the rules; kinds in the order in which they are listed.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models may judge, if they hold a letter; shorter ones carry too little evidence. Of random strings of 12
#: to 19 characters over five alphabets, 96 % or more pass the thresholds below.
TOKEN = "[A-Za-z0-9+/_=-]{12,}"
#: Symbols of the models: each pair of the 128 ASCII codes is a cell.
CODES = 128
#: Texts whose words are ordinary samples, at most; the models do not grow with the corpus.
FIT_ROWS = 2_000
#: A token is a secret from this ratio per pair and this total, in thousandths of a nat; the total outweighs odds of a
#: million ordinary tokens to one secret.
PER_PAIR, TOTAL = 600, 14_000
MATCH = "struct<start:int,end:int,said:string>"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(items: Column, zero: Column, step, out, kind: str, chunk: int = 256) -> Column:
    """``out(state, item)`` for each item of an array, where ``step(state, item)`` is the state of the next one.

    Results are appended within chunks, and chunks are joined once, so the work grows with the number of items and not
    with its square. ``kind`` is the SQL type of a result.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(state: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(state.alias("state"), none.alias("out")),
            lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(out(acc["state"], x))).alias("out")),
        )

    def whole(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / chunk).cast("int")), lambda j: F.slice(all_, j * chunk + 1, F.lit(chunk)))
        done = F.aggregate(parts, F.array(F.struct(zero.alias("state"), none.alias("out"))), lambda acc, part: F.concat(acc, F.array(one(F.element_at(acc, -1)["state"], part))))
        return F.flatten(F.transform(done, lambda x: x["out"]))

    return bound(items, lambda all_: F.when(F.size(all_) > 0, whole(all_)).otherwise(none))


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern: array of (start, end, said), end exclusive, in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def places(both: Column) -> Column:
        # before match i lie the gaps 0..i and the matches 0..i-1
        items = F.zip_with(both["hits"], F.slice(both["gaps"], F.lit(1), F.size(both["hits"])), lambda h, g: F.struct(h.alias("said"), F.length(g).alias("gap"), F.length(h).alias("long")))
        here = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["long"]).alias("end"), x["said"].alias("said"))
        return running(items, F.lit(0), lambda at, x: at + x["gap"] + x["long"], here, MATCH)

    # most texts have no match; only the others are split
    return bound(hits, lambda h: F.when(F.size(h) > 0, bound(F.struct(h.alias("hits"), gaps.alias("gaps")), places)).otherwise(F.expr(f"cast(array() as array<{MATCH}>)")))


def base_spans(text: Column) -> Column:
    """Spans of the rules: array of (start, kind index, end, said) by start, then kind."""
    assign = F.filter(found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["said"], ASSIGN, 1)) >= 12)
    rows = [(0, assign), (1, found(text, ACCESS)), (2, found(text, HEX))]
    return F.array_sort(F.concat(*[of_kind(x, k) for k, x in rows]))


def of_kind(matches: Column, kind: int) -> Column:
    """Matches with the index of their kind."""
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["said"].alias("said")))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


# --- models ------------------------------------------------------------------------------------------------------


def random_samples(spark: SparkSession, rows: int = 4_000) -> DataFrame:
    """Labelled random strings: hexadecimal, base64 and mixed alphanumeric, from SHA-512 of a running number."""
    base = spark.range(rows).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512).alias("h"), F.col("id"))
    wide = F.base64(F.unhex("h"))
    said = F.when(F.col("id") % 4 == 0, F.substring("h", 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring("h", 1, 40))).when(F.col("id") % 4 == 2, F.substring(wide, 1, 40)).otherwise(F.substring(F.regexp_replace(wide, "[+/=]", ""), 1, 40))
    return base.select(said.alias("said"), F.lit(1).alias("random"))


def ordinary_samples(docs: DataFrame, text: str, doc_id: str, rows: int = FIT_ROWS) -> DataFrame:
    """Labelled ordinary identifiers: the words of letters of at most ``rows`` documents (smallest id hash), alone and
    joined in pairs as in names of code (``two_words``, ``two-words``, ``twoWords``, ``TWO_WORDS``). Words count once."""
    ids = docs.select(F.col(doc_id).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id", F.lit(7)), "id").limit(rows)
    # a pair of ids that share texts does no harm: words are counted once
    words = (
        docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).join(F.broadcast(ids), "id", "left_semi")
        .select(F.explode(F.regexp_extract_all("t", F.lit("(?<![A-Za-z0-9+/_=.@-])[A-Za-z]{2,24}(?![A-Za-z0-9+/_=@-])"), F.lit(0))).alias("w")).distinct()
    )
    fixed = F.array(*[F.lit(w) for w in ("get", "value", "user", "data", "file", "list", "index", "name")])
    other = F.get(fixed, F.pmod(F.xxhash64("w"), F.lit(8)).cast("int"))
    forms = F.array("w", F.concat_ws("_", F.lower("w"), other), F.concat_ws("-", other, F.lower("w")), F.concat(other, F.initcap("w")), F.upper(F.concat_ws("_", "w", other)))
    return words.select(F.explode(forms).alias("said"), F.lit(0).alias("random"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """How often each character pair occurs in the samples of each label: ``random``, ``cell``, ``n``; at most 2 x 16384 rows."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("said") - 1), lambda i: F.ascii(F.substring(F.col("said"), i, F.lit(1))) * CODES + F.ascii(F.substring(F.col("said"), i + 1, F.lit(1))))
    return samples.where("length(said) > 1").select("random", F.explode(pairs).alias("cell")).groupBy("random", "cell").agg(F.count("*").alias("n"))


def ratios(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Log of the ratio of both models' transition probabilities for each cell, in thousandths: 16384 integers.

    Additive smoothing over the 66 symbols of tokens. The table has a fixed size, so it may pass through the driver.
    """
    import math

    seen: dict[tuple[int, int], int] = {(r["random"], r["cell"]): r["n"] for r in pair_counts(samples).collect()}
    total = {(k, a): sum(seen.get((k, a * CODES + b), 0) for b in range(CODES)) for k in (0, 1) for a in range(CODES)}
    chance = lambda k, a, b: (seen.get((k, a * CODES + b), 0) + smoothing) / (total[k, a] + 66 * smoothing)
    return [round(1000 * math.log(chance(1, a, b) / chance(0, a, b))) for a in range(CODES) for b in range(CODES)]


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list[int]:
    return ratios(random_samples(docs.sparkSession).unionByName(ordinary_samples(docs, text, doc_id)))


def log_ratio(token: Column, table: list[int]) -> Column:
    """Sum over the character pairs of an ASCII token, in thousandths of a nat."""
    cells = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    codes = F.transform(F.split(token, ""), F.ascii)
    return F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), F.lit(0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(cells, acc["last"] * CODES + c)).alias("sum")),
        lambda acc: acc["sum"],
    )


def untouched(base: Column, tokens: Column) -> Column:
    """The tokens (start, end, said) that no span of ``base`` (start, kind, end, said) overlaps.

    Both are merged by start: a token is free if all spans before it end by its start, and the next begins at its end
    or later.
    """
    last = F.lit(2**31 - 1)

    def free(events: Column) -> Column:
        before = running(events, F.lit(0), lambda at, x: F.when(x["kind"] < 3, F.greatest(at, x["end"])).otherwise(at), lambda at, x: at, "int")
        after = F.reverse(running(F.reverse(events), last, lambda at, x: F.when(x["kind"] < 3, F.least(at, x["start"])).otherwise(at), lambda at, x: at, "int"))
        room = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        judged = F.zip_with(events, room, lambda e, r: F.struct(e.alias("e"), ((e["kind"] == 3) & (r["a"] <= e["start"]) & (r["b"] >= e["end"])).alias("free")))
        return F.transform(F.filter(judged, lambda x: x["free"]), lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["said"].alias("said")))

    return F.when(F.size(base) == 0, tokens).otherwise(bound(F.array_sort(F.concat(base, of_kind(tokens, 3))), free))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table: list[int] | None = None) -> DataFrame:
    """All columns of ``docs`` and a struct ``secrets`` (another name if taken): ``base`` and ``spans``.

    ``base`` holds the spans of the rules, ``spans`` those and the tokens that the models call random and that no rule
    touches (numbers without a letter are not judged); each span is (start, kind, end, said), by start, then kind as in
    ``KINDS``. Null texts count as empty and have
    no spans; rows repeat as in ``docs``; an empty table gives an empty table. Time grows with the length of a text and
    its number of matches, not with the square. ``table``: ratios trained before.
    """
    table = train(docs, text, doc_id) if table is None else table
    t, base, tokens, out = fresh(docs, "t", "base", "tokens", "secrets")
    names = [F.col(f"`{c}`") for c in docs.columns]
    pairs = lambda x: F.length(x["said"]) - 1
    judged = F.filter(F.transform(untouched(F.col(base), F.col(tokens)), lambda x: F.struct(x.alias("x"), log_ratio(x["said"], table).alias("r"))), lambda y: (y["r"] >= TOTAL) & (y["r"] >= PER_PAIR * pairs(y["x"])) & y["x"]["said"].rlike("[A-Za-z]"))
    more = of_kind(F.transform(judged, lambda y: y["x"]), 3)
    return (
        docs.withColumn(t, text_of(text))
        .withColumn(base, base_spans(F.col(t)))
        .withColumn(tokens, found(F.col(t), TOKEN))
        .select(*names, F.struct(F.col(base).alias("base"), F.when(F.size(tokens) > 0, F.array_sort(F.concat(F.col(base), more))).otherwise(F.col(base)).alias("spans")).alias(out))
    )


#: Code points of a block of a text; a part of a text is cut from the blocks that hold it.
BLOCK = 1024


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by a mark. A null text without spans stays null.

    The parts between the marks are cut from blocks of the text and joined once, so time grows with the length.
    """

    def part(blocks: Column, a: Column, b: Column) -> Column:
        first, last = (a / BLOCK).cast("int"), ((b - 1) / BLOCK).cast("int")
        return F.when(b > a, F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), a - first * BLOCK + 1, b - a)).otherwise("")

    def cut(both: Column) -> Column:
        blocks, own = both["blocks"], both["spans"]
        kept = running(own, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] < at, "").otherwise(F.concat(part(blocks, at, s["start"]), F.lit(mark))), "string")
        return F.concat(F.array_join(kept, ""), part(blocks, F.array_max(F.transform(own, lambda s: s["end"])), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bound(F.struct(blocks.alias("blocks"), spans.alias("spans")), cut)).otherwise(text)
