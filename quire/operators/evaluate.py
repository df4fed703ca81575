"""Evaluation of recognised lines against ground truth, per page.

Predictions: page, ``pred_idx``, x, y, width, height, and for text metrics ``text``; truths: page, ``ref_idx``, box and
``text``. The theta-join carries the page as its equi-key, so pages never meet each other's boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import geometry as g
from quire.functions.numeric import ratio
from quire.functions.text import edit_distance, is_blank


def match_candidates(pred: DataFrame, truth: DataFrame, page: str = "page_id", least: float = 0.1) -> DataFrame:
    """Pairs of a page whose overlap reaches ``least``: page, pred_idx, ref_idx, iou. Predictions without a box match nothing."""
    p = pred.where(F.col("x").isNotNull()).select(page, "pred_idx", g.box().alias("p"))
    t = truth.select(page, "ref_idx", g.box().alias("t"))
    return p.join(t, page).withColumn("iou", g.iou(F.col("p"), F.col("t"))).where(F.col("iou") >= least).drop("p", "t")


def match_regions(pred: DataFrame, truth: DataFrame, page: str = "page_id", least: float = 0.1) -> DataFrame:
    """Greedy one-to-one matches by descending overlap, then indexes: page, pred_idx, ref_idx, iou."""
    pairs = match_candidates(pred, truth, page, least)
    item = F.struct((-F.col("iou")).alias("k"), F.col("pred_idx").cast("long").alias("p"), F.col("ref_idx").cast("long").alias("r"))
    none = F.expr("cast(array() as array<struct<k:double,p:bigint,r:bigint>>)")
    taken = lambda acc, c: F.exists(acc, lambda m: (m["p"] == c["p"]) | (m["r"] == c["r"]))
    kept = F.aggregate(F.array_sort(F.collect_list(item)), none, lambda acc, c: F.when(taken(acc, c), acc).otherwise(F.concat(acc, F.array(c))))
    matched = pairs.groupBy(page).agg(kept.alias("m"))
    return matched.select(page, F.explode("m").alias("m")).select(page, F.col("m.p").alias("pred_idx"), F.col("m.r").alias("ref_idx"), (-F.col("m.k")).alias("iou"))


def unmatched_predictions(pred: DataFrame, matches: DataFrame, page: str = "page_id") -> DataFrame:
    return pred.join(matches.select(page, "pred_idx"), [page, "pred_idx"], "left_anti")


def missed_truths(truth: DataFrame, matches: DataFrame, page: str = "page_id") -> DataFrame:
    return truth.join(matches.select(page, "ref_idx"), [page, "ref_idx"], "left_anti")


def detection_metrics(n_matched: Column, n_pred: Column, n_truth: Column) -> list[Column]:
    recall, precision = ratio(n_matched, n_truth), ratio(n_matched, n_pred)
    return [recall.alias("recall"), precision.alias("precision"), F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0)).alias("f1")]


def per_page_counts(pred: DataFrame, truth: DataFrame, matches: DataFrame, page: str = "page_id") -> DataFrame:
    """Predictions, truths and matches of every page that has either."""
    one = lambda df, p, t, m: df.select(page, F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(m).alias("m"))
    rows = one(pred, 1, 0, 0).unionByName(one(truth, 0, 1, 0)).unionByName(one(matches, 0, 0, 1))
    return rows.groupBy(page).agg(F.sum("p").alias("predicted"), F.sum("t").alias("reference"), F.sum("m").alias("true_positive"))


def detection_prf(pred: DataFrame, truth: DataFrame, page: str = "page_id", least: float = 0.1) -> DataFrame:
    """Recall, precision and F1 of every page; 0 where a denominator is 0."""
    counts = per_page_counts(pred, truth, match_regions(pred, truth, page, least), page)
    return counts.select("*", *detection_metrics(F.col("true_positive"), F.col("predicted"), F.col("reference")))


def order_accuracy(pred: DataFrame, matches: DataFrame, page: str = "page_id") -> DataFrame:
    """Share of pairs of matches in the right order; one match gives 1. Pages without matches have no row (count as 0).

    Matches are ordered by ``reading_order`` of the prediction, or its index where that is null.
    """
    order = F.coalesce("reading_order", "pred_idx") if "reading_order" in pred.columns else F.col("pred_idx")
    keyed = matches.join(pred.select(page, "pred_idx", order.alias("o")), [page, "pred_idx"])
    ranked = keyed.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "pred_idx", "ref_idx"))), lambda m: m["ref_idx"]).alias("r"))
    later = F.aggregate(
        F.transform("r", lambda v, i: F.size(F.filter(F.slice(F.col("r"), i + 2, F.size("r")), lambda w: v < w))), F.lit(0).cast("long"), lambda a, v: a + v
    )
    n = F.size("r").cast("double")
    return ranked.select(page, F.when(n <= 1, F.lit(1.0)).otherwise(later / (n * (n - 1) / 2)).alias("order_accuracy"))


def text_metrics(pred: DataFrame, truth: DataFrame, matches: DataFrame, page: str = "page_id", normalize: Callable[[Column], Column] = lambda c: c, prefix: str = "") -> DataFrame:
    """Micro-averaged character error rate and exact line rate of every page with predictions or truths.

    Missed truths compare with the empty text, unmatched predictions count with their length. A truth's text is its
    ``normalized_text`` where it has one.
    """
    expected = F.coalesce("normalized_text", "text") if "normalized_text" in truth.columns else F.col("text")
    t = truth.select(page, "ref_idx", normalize(expected).alias("want"))
    p = pred.select(page, "pred_idx", normalize(F.col("text")).alias("got"))
    lines = t.join(matches.select(page, "ref_idx", "pred_idx"), [page, "ref_idx"], "left").join(p, [page, "pred_idx"], "left")
    got = F.coalesce("got", F.lit(""))
    compared = lines.select(page, F.length("want").alias("chars"), edit_distance(F.col("want"), got).alias("edits"), (F.col("want") == got).cast("int").alias("exact"), F.lit(1).alias("line"))
    extra = unmatched_predictions(p, matches, page).select(page, F.lit(0).alias("chars"), F.length("got").alias("edits"), F.lit(0).alias("exact"), F.lit(0).alias("line"))
    sums = compared.unionByName(extra).groupBy(page).agg(*[F.sum(c).alias(c) for c in ("chars", "edits", "exact", "line")])
    rate = F.when(F.col("chars") > 0, F.col("edits") / F.col("chars")).otherwise(F.when(F.col("edits") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return sums.select(
        page, rate.alias(f"{prefix}cer"), ratio(F.col("exact"), F.col("line")).alias(f"{prefix}exact_rate"),
        F.col("chars").alias(f"{prefix}reference_characters"), F.col("edits").alias(f"{prefix}edit_distance"),
    )


def empty_rate(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """Share of lines of each page with no text but white space."""
    return lines.groupBy(page).agg(F.avg(F.when(is_blank(F.col("text")), 1.0).otherwise(0.0)).alias("empty_rate"))


def error_detection(pred: DataFrame, truth: DataFrame, matches: DataFrame, page: str = "page_id", threshold: float = 0.58) -> DataFrame:
    """Share of errors that low confidence points to: wrong or unmatched predictions of low confidence over these and misses.

    Texts are compared as they are. Low: uncertain, no score, a score below the threshold, or no end mark.
    """
    has = set(pred.columns)
    score = F.col("recognition_score") if "recognition_score" in has else F.lit(None).cast("double")
    low = score.isNull() | (score < threshold)
    if "uncertain" in has:
        low = low | F.coalesce("uncertain", F.lit(False))
    if "ended_with_eos" in has:
        low = low | ~F.coalesce("ended_with_eos", F.lit(True))
    p = pred.select(page, "pred_idx", F.col("text").alias("got"), F.coalesce(low, F.lit(True)).alias("low"))
    joined = p.join(matches.select(page, "pred_idx", "ref_idx"), [page, "pred_idx"], "left").join(truth.select(page, "ref_idx", F.col("text").alias("want")), [page, "ref_idx"], "left")
    wrong = F.col("want").isNull() | (F.col("got") != F.col("want"))
    errors = joined.where(wrong).select(page, F.lit(1).alias("e"), F.col("low").cast("int").alias("l"))
    missed = missed_truths(truth, matches, page).select(page, F.lit(1).alias("e"), F.lit(0).alias("l"))
    return errors.unionByName(missed).groupBy(page).agg((F.sum("l") / F.sum("e")).alias("error_detection_rate"))


def page_metrics(
    pred: DataFrame, truth: DataFrame, page: str = "page_id", least: float = 0.1, threshold: float = 0.58, normalize: Callable[[Column], Column] | None = None
) -> DataFrame:
    """All metrics of every page with predictions or truths; ``normalize`` adds normalised text metrics.

    Matching runs once: matched truths meet their predictions in one full outer join, where every prediction and every
    truth has one row, and one aggregation by page computes what the single functions above do.
    """
    has = set(pred.columns)
    score = F.col("recognition_score").cast("double") if "recognition_score" in has else F.lit(None).cast("double")
    low = score.isNull() | (score < threshold)
    if "uncertain" in has:
        low = low | F.coalesce("uncertain", F.lit(False))
    if "ended_with_eos" in has:
        low = low | ~F.coalesce("ended_with_eos", F.lit(True))
    order = F.coalesce("reading_order", "pred_idx") if "reading_order" in has else F.col("pred_idx")
    expected = F.coalesce("normalized_text", "text") if "normalized_text" in truth.columns else F.col("text")
    p = pred.select(page, "pred_idx", F.col("text").alias("got"), F.coalesce(low, F.lit(True)).alias("low"), order.alias("o"))
    t = truth.select(page, "ref_idx", F.col("text").alias("raw"), expected.alias("want"))
    matched = t.join(match_regions(pred, truth, page, least).select(page, "ref_idx", "pred_idx"), [page, "ref_idx"], "left")
    rows = p.join(matched, [page, "pred_idx"], "full_outer")
    is_pred, is_truth = F.col("low").isNotNull(), F.col("ref_idx").isNotNull()
    both = is_pred & is_truth
    wrong = is_pred & (~is_truth | (F.col("got") != F.col("raw")))

    def sums(prefix: str, f: Callable[[Column], Column]) -> list[Column]:
        want, got = f(F.col("want")), f(F.coalesce("got", F.lit("")))
        return [
            F.sum(F.when(is_truth, F.length(want)).otherwise(0)).alias(f"{prefix}chars"),
            F.sum(F.when(is_truth, edit_distance(want, got)).otherwise(F.length(got))).alias(f"{prefix}edits"),
            F.count_if(is_truth & (want == got)).alias(f"{prefix}exact"),
        ]

    def shown(prefix: str) -> list[Column]:
        chars, edits = F.col(f"{prefix}chars"), F.col(f"{prefix}edits")
        rate = F.when(chars > 0, edits / chars).otherwise(F.when(edits > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        return [
            rate.alias(f"{prefix}cer"), ratio(F.col(f"{prefix}exact"), F.col("reference")).alias(f"{prefix}exact_rate"),
            chars.alias(f"{prefix}reference_characters"), edits.alias(f"{prefix}edit_distance"),
        ]

    sets = {"": lambda c: c} | ({"normalized_": normalize} if normalize else {})
    totals = rows.groupBy(page).agg(
        F.count_if(is_pred).alias("predicted"), F.count_if(is_truth).alias("reference"), F.count_if(both).alias("true_positive"),
        *[c for prefix, f in sets.items() for c in sums(prefix, f)],
        F.count_if(is_pred & is_blank(F.col("got"))).alias("blank"), F.count_if(wrong).alias("wrong"), F.count_if(wrong & F.col("low")).alias("pointed"),
        F.array_sort(F.collect_list(F.when(both, F.struct("o", "pred_idx", "ref_idx")))).alias("ranks"),
    )
    ranks, n = F.transform("ranks", lambda m: m["ref_idx"]), F.col("true_positive")
    later = F.aggregate(F.transform(ranks, lambda v, i: F.size(F.filter(F.slice(ranks, i + 2, F.size(ranks)), lambda w: v < w))), F.lit(0).cast("long"), lambda a, v: a + v)
    errors = F.col("wrong") + F.col("reference") - n
    return totals.select(
        page, "predicted", "reference", "true_positive", *detection_metrics(n, F.col("predicted"), F.col("reference")), *[c for prefix in sets for c in shown(prefix)],
        F.when(n > 1, later / (n * (n - 1) / 2)).otherwise(n.cast("double")).alias("order_accuracy"),
        ratio(F.col("blank"), F.col("predicted")).alias("empty_rate"), ratio(F.col("pointed"), errors).alias("error_detection_rate"),
    )


def screen_averages(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """Mean recognition (or else detection) score and mean detection score of each page, in whole percent."""
    whole = lambda c: F.floor(F.avg(c) * 100 + 0.5).cast("int")
    return lines.groupBy(page).agg(whole(F.coalesce("recognition_score", "detection_score")).alias("recognition_percent"), whole(F.col("detection_score")).alias("detection_percent"))


def indexed(frame: DataFrame, page: str, name: str, *order: str) -> DataFrame:
    """Number the rows of each page from 0 in the given order."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1)
