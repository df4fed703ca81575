"""Recognition scores: decoding, confidence, and the choice among competing candidates of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.numeric import FLOOR, let, log_softmax, probability
from quire.functions.text import is_blank, merge_pieces, utf16_length, within
from quire.plans.config import RETRY

EPSILON = 1e-9


def decode(logits: Column, length: int, classes: int, charset: Column) -> Column:
    """Greedy decoding of ``length`` positions of ``classes`` logits; class 0 ends the text.

    Struct: text, recognition_score (geometric mean over the tokens and the end mark), token_scores, token_margins,
    minimum_token_score, mean_token_margin, eos_score, ended_with_eos. ``charset`` is an array of the classes from 1.
    """
    spots = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: log_softmax(F.slice(logits, p * classes + 1, F.lit(classes))))

    def read(row: Column) -> Column:
        def found(x: Column) -> Column:
            # equal values share the top, so the margin is 0 then
            second = F.array_max(F.filter(x["row"], lambda v, i: i != x["best"]))
            margin = F.when(second > float("-inf"), F.greatest(F.lit(0.0), x["top"] - second)).otherwise(F.lit(0.0))
            return F.struct(x["best"].alias("best"), probability(x["top"]).alias("p"), margin.alias("margin"), probability(F.get(x["row"], F.lit(0))).alias("eos"))

        placed = lambda x: F.struct(row.alias("row"), x.alias("top"), (F.greatest(F.lit(1), F.array_position(row, x).cast("int")) - 1).alias("best"))
        return let(let(F.array_max(row), placed), found)

    def cut(seen: Column) -> Column:
        e = F.array_position(F.transform(seen, lambda s: s["best"]), F.lit(0)).cast("int")
        return let(e, lambda e: F.struct(
            F.slice(seen, F.lit(1), F.when(e > 0, e - 1).otherwise(F.lit(length))).alias("tokens"),
            F.get(seen, F.when(e > 0, e - 1).otherwise(F.lit(length - 1))).alias("last"), (e > 0).alias("ended"),
        ))

    def out(x: Column) -> Column:
        tokens, last = x["tokens"], x["last"]
        scores = F.transform(tokens, lambda t: t["p"])
        margins = F.transform(tokens, lambda t: t["margin"])
        nll = F.aggregate(tokens, F.lit(0.0), lambda a, t: a - F.log(t["p"]))
        final = F.when(x["ended"], -F.log(last["p"])).otherwise(-F.log(F.greatest(F.lit(FLOOR), last["eos"])))
        n = F.size(tokens)
        return F.struct(
            F.array_join(F.transform(tokens, lambda t: F.coalesce(F.get(charset, t["best"] - 1), F.lit(""))), "").alias("text"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-(nll + final) / (n + 1)))).alias("recognition_score"),
            scores.alias("token_scores"),
            margins.alias("token_margins"),
            F.when(n > 0, F.array_min(scores)).otherwise(last["eos"]).alias("minimum_token_score"),
            F.when(n > 0, F.aggregate(margins, F.lit(0.0), lambda a, m: a + m) / n).otherwise(F.lit(0.0)).alias("mean_token_margin"),
            last["eos"].alias("eos_score"),
            x["ended"].alias("ended_with_eos"),
        )

    return let(let(F.transform(spots, read), cut), out)


def low_confidence(c: Column, b: Column, profile: str) -> Column:
    """Whether a recognition is worth a retry. ``c`` has the fields of :func:`decode`, ``b`` is the line's box."""
    threshold = RETRY.get(profile, RETRY["balanced"])
    return (
        is_blank(c["text"]) | ~c["ended_with_eos"] | (c["recognition_score"] < threshold) | (c["minimum_token_score"] < 0.28)
        | (c["mean_token_margin"] < 0.35) | ((g.aspect(b) >= 8) & (utf16_length(c["text"]) < 2))
    )


def shown_as_low(line: Column, profile: str) -> Column:
    """The display's rule: an unknown score counts as low, and so does an uncertain choice; other unknowns do not."""
    threshold = RETRY.get(profile, RETRY["balanced"])
    no = lambda test: F.coalesce(test, F.lit(False))
    return (
        line["recognition_score"].isNull() | no(line["recognition_score"] < threshold) | no(line["minimum_token_score"] < 0.28)
        | no(line["mean_token_margin"] < 0.35) | no(~line["ended_with_eos"]) | no(line["uncertain"])
    )


def try_direction(low: Column, b: Column, profile: str) -> Column:
    return low & ((g.aspect(b) < 1.8) | F.lit(profile == "accurate"))


def utility(c: Column) -> Column:
    """One number for a candidate: scores and margin, less for a missing end, an empty text or a doubtful end mark."""
    margin = 1 - F.exp(-F.greatest(F.lit(0.0), c["mean_token_margin"]))
    eos = F.coalesce(c["eos_score"], F.when(c["ended_with_eos"], F.lit(1.0)).otherwise(F.lit(0.0)))
    return (
        c["recognition_score"] * 0.65 + c["minimum_token_score"] * 0.2 + margin * 0.15
        - F.when(c["ended_with_eos"], F.lit(0.0)).otherwise(F.lit(0.12))
        - F.when(F.length(c["text"]) > 0, F.lit(0.0)).otherwise(F.lit(0.08))
        - F.when(eos < 0.2, F.lit(0.04)).otherwise(F.lit(0.0))
    )


#: Fields of a candidate, in order; ``ord`` is its place among the candidates of the line.
FIELDS = {
    "ord": "int", "text": "string", "recognition_score": "double", "minimum_token_score": "double", "mean_token_margin": "double", "eos_score": "double",
    "ended_with_eos": "boolean", "source": "string", "preprocessing": "string", "orientation": "string", "deskew_angle": "double",
}


def candidate(frame: DataFrame) -> Column:
    """The candidate struct of a row, with missing columns null."""
    return F.struct(*[(F.col(c) if c in frame.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])


def same_cluster(a: Column, b: Column) -> Column:
    """Whether two texts are readings of the same line: equal, or a quarter of the length apart at most (1 at least)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((longest <= 1) | (a == b), a == b).otherwise(within(a, b, F.greatest(F.lit(1), F.floor(longest * 0.25).cast("int"))))


def _kinds(cluster: Column) -> Column:
    kind = lambda c: F.concat_ws(":", c["source"], c["preprocessing"], F.coalesce(c["orientation"], F.lit("auto")), F.coalesce(c["deskew_angle"], F.lit(0.0)).cast("string"))
    return F.size(F.array_distinct(F.transform(cluster, kind)))


def _original(c: Column) -> Column:
    return F.coalesce((c["source"] == "page") & (c["preprocessing"] == "original"), F.lit(False))


def _best(cluster: Column) -> Column:
    """The best of a cluster: utility beyond a tolerance, then the page's original, then the first."""

    def better(best: Column, c: Column) -> Column:
        gain = c["u"] - best["u"]
        return (gain > EPSILON) | ((F.abs(gain) <= EPSILON) & (_original(c) & ~_original(best) | ((_original(c) == _original(best)) & (c["ord"] < best["ord"]))))

    rest = F.slice(cluster, F.lit(2), F.greatest(F.size(cluster) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(cluster, F.lit(0)), lambda best, c: F.when(better(best, c), c).otherwise(best))


def select_candidates(candidates: DataFrame, *keys: str) -> DataFrame:
    """Choose among the candidates of each line by consensus: keys, ``selected``, ``alternatives``, ``uncertain``, ``reason``.

    Candidates, in order, join the first cluster that has a similar reading. The cluster of most kinds of image wins, then
    of most members, then of the best candidate. The reason is ``consensus`` if any cluster has two kinds of image,
    ``original-tie`` if the page's original is chosen and another candidate is as good, else ``score``. A choice among
    several without consensus is uncertain.
    """
    fields = ",".join(f"{c}:{t}" for c, t in FIELDS.items())
    item = candidate(candidates)
    lines = candidates.select(*keys, item.alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"c.{f}") for f in FIELDS], utility(F.col("c")).alias("u")))).alias("all"))
    empty = F.expr(f"cast(array() as array<array<struct<{fields},u:double>>>)")

    def add(acc: Column, c: Column) -> Column:
        similar = lambda cluster: F.exists(cluster, lambda o: same_cluster(o["text"], c["text"]))
        at = F.get(F.filter(F.transform(acc, lambda x, i: F.when(similar(x), i)), lambda i: i.isNotNull()), F.lit(0))
        grown = lambda k: F.transform(acc, lambda x, i: F.when(i == k, F.concat(x, F.array(c))).otherwise(x))
        # a lambda binds the place, so that distances are computed once
        return F.get(F.transform(F.array(at), lambda k: F.when(k.isNull(), F.concat(acc, F.array(F.array(c)))).otherwise(grown(k))), F.lit(0))

    grouped = lines.withColumn("clusters", F.aggregate("all", empty, add))
    judged = grouped.withColumn("judged", F.transform("clusters", lambda x, i: F.struct(_kinds(x).alias("kinds"), F.size(x).alias("n"), _best(x)["u"].alias("u"), (-i).alias("first"), _best(x).alias("best"))))
    won = judged.withColumn("won", F.array_max("judged"))
    agreed = (F.size("all") > 1) & F.exists("judged", lambda j: j["kinds"] >= 2)
    chosen = F.col("won.best")
    tie = F.exists("all", lambda c: (c["ord"] != chosen["ord"]) & (F.abs(c["u"] - chosen["u"]) <= EPSILON))
    reason = F.when(agreed, "consensus").when(_original(chosen) & tie, "original-tie").otherwise("score")
    strip = lambda c, drop=(): F.struct(*[c[f].alias(f) for f in FIELDS if f not in drop])
    others = F.transform(F.filter("all", lambda c: c["ord"] != chosen["ord"]), lambda c: strip(c, ("ord",)))
    return won.select(*keys, strip(chosen).alias("selected"), others.alias("alternatives"), ((F.size("all") > 1) & ~agreed).alias("uncertain"), reason.alias("reason"))


def top_score(candidates: DataFrame, *keys: str) -> DataFrame:
    """The candidate of the highest recognition score of each line (ties: the first): keys and ``selected``."""
    item = candidate(candidates)
    return candidates.groupBy(*keys).agg(F.max_by(item, F.struct(F.col("recognition_score").cast("double"), -F.col("ord"))).alias("selected"))


def compare_strategies(candidates: DataFrame, *keys: str) -> DataFrame:
    """Choice by consensus against choice by score alone: keys, consensus_text, score_text, differs."""
    a = select_candidates(candidates, *keys).select(*keys, F.col("selected.text").alias("consensus_text"))
    b = top_score(candidates, *keys).select(*keys, F.col("selected.text").alias("score_text"))
    return a.join(b, list(keys)).withColumn("differs", F.col("consensus_text") != F.col("score_text"))


def combine_segments(segments: DataFrame, *keys: str, order: str = "index") -> DataFrame:
    """Join the recognitions of a line's windows: merged text, mean score and margin, least token score, all ended.

    Lines whose pieces do not fit together have a null text.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"])
    grouped = segments.groupBy(*keys).agg(
        texts.alias("_texts"), F.avg("recognition_score").alias("recognition_score"), F.min("minimum_token_score").alias("minimum_token_score"),
        F.avg("mean_token_margin").alias("mean_token_margin"), F.every("ended_with_eos").alias("ended_with_eos"),
    )
    return grouped.withColumn("text", merge_pieces(F.col("_texts"))).drop("_texts")
