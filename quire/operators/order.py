"""Reading order: writing mode, layout blocks, bands and ranks, per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.numeric import upper_median


def writing_mode(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page: vertical if at least half (rounded up) of the boxes are taller than 1.2 widths."""
    tall = F.count_if(F.col("height") > F.col("width") * 1.2)
    n = F.count("*")
    return boxes.groupBy(page).agg(n.alias("n"), tall.alias("n_vertical"), F.when(tall >= F.ceil(n / 2), "vertical").otherwise("horizontal").alias("mode"))


def _oriented(boxes: DataFrame, page: str, mode: str) -> DataFrame:
    """Boxes with transverse centre ``t``, longitudinal centre ``l``, and start, end and spans along both axes."""
    whole = Window.partitionBy(page)
    tall = F.count_if(F.col("height") > F.col("width") * 1.2).over(whole)
    n = F.count("*").over(whole)
    vertical = F.lit(mode == "vertical") if mode in ("vertical", "horizontal") else tall >= F.ceil(n / 2)
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width", "height"))
    pick = lambda v, o: F.when(F.col("_vertical"), v).otherwise(o)
    return boxes.withColumn("_vertical", vertical).withColumns({
        "_n": n, "_t": pick(x + w / 2, y + h / 2), "_l": pick(y + h / 2, x + w / 2),
        "_start": pick(y, x), "_span": pick(h, w), "_across": pick(w, h),
    })


def layout_blocks(boxes: DataFrame, page: str = "page_id", mode: str = "auto") -> DataFrame:
    """Columns of ``boxes`` with ``block`` (0, 1, ...): runs of boxes with clear gaps along the writing direction.

    A page of under four boxes, or whose spans differ by less than 1.8 times, is one block. A cut falls where a box starts
    at least max(6, 4 % of the least span) after the end of the box before it in order of starts.
    """
    whole = Window.partitionBy(page)
    # the order of starts is taken from centre minus half span, as the rule computes it
    order = whole.orderBy(F.col("_l") - F.col("_span") / 2, "det_idx")
    least, most = F.min("_span").over(whole), F.max("_span").over(whole)
    one = (F.col("_n") < 4) | (F.col("_least") <= 0) | (F.col("_most") / F.when(F.col("_least") > 0, F.col("_least")) < 1.8)
    gap = F.col("_start") - F.lag(F.col("_start") + F.col("_span")).over(order)
    cut = F.when(~one & (gap >= F.greatest(F.lit(6.0), F.col("_least") * 0.04)), 1).otherwise(0)
    out = _oriented(boxes, page, mode).withColumns({"_least": least, "_most": most}).withColumn("_cut", cut)
    return out.withColumn("block", F.sum("_cut").over(order).cast("int")).select(*boxes.columns, "block", "_vertical", "_t", "_l", "_across")


def bands(items: Column, threshold: Column) -> Column:
    """Group boxes (structs with t, in order) into bands: each joins the first band whose mean centre is near enough."""
    empty = F.expr("cast(array() as array<struct<total:double,n:int,items:array<struct<t:double,l:double,idx:bigint>>>>)")

    def add(acc: Column, item: Column) -> Column:
        mean_near = lambda b: F.abs(b["total"] / b["n"] - item["t"]) <= threshold
        places = F.filter(F.transform(acc, lambda b, i: F.when(mean_near(b), i)), lambda i: i.isNotNull())
        at = F.get(places, F.lit(0))
        grown = F.transform(
            acc,
            lambda b, i: F.when(i == at, F.struct((b["total"] + item["t"]).alias("total"), (b["n"] + 1).alias("n"), F.concat(b["items"], F.array(item)).alias("items"))).otherwise(b),
        )
        fresh = F.array(F.struct(item["t"].alias("total"), F.lit(1).alias("n"), F.array(item).alias("items")))
        return F.when(F.size(places) > 0, grown).otherwise(F.concat(acc, fresh))

    return F.aggregate(items, empty, add)


def reading_order(boxes: DataFrame, page: str = "page_id", mode: str = "auto", scattered: bool = False) -> DataFrame:
    """Columns of ``boxes`` with ``reading_order`` (0, 1, ... per page).

    Blocks in order; in a block, bands from right to left (vertical) or top to bottom; in a band, along the line.
    Scattered writing keeps the order of detection.
    """
    if scattered:
        return boxes.withColumn("reading_order", F.row_number().over(Window.partitionBy(page).orderBy("det_idx")) - 1)
    laid = layout_blocks(boxes, page, mode)
    item = F.struct(F.col("_t").alias("t"), F.col("_l").alias("l"), F.col("det_idx").cast("long").alias("idx"))
    # the band width comes from all boxes of the page, so pages are gathered once
    pages = laid.groupBy(page).agg(F.max("_vertical").alias("v"), F.collect_list("_across").alias("across"), F.collect_list(F.struct(F.col("block").alias("block"), item.alias("item"))).alias("all"))
    threshold = F.greatest(F.lit(4.0), upper_median(F.col("across")) * 0.65)
    blocks = pages.withColumn("threshold", threshold).withColumn("block", F.explode(F.array_distinct(F.transform("all", lambda x: x["block"]))))
    own = F.array_sort(F.transform(F.filter("all", lambda x: x["block"] == F.col("block")), lambda x: x["item"]))
    split = blocks.select(page, "v", "block", F.posexplode(bands(own, F.col("threshold"))).alias("band", "b"))
    key = F.col("b.total") / F.col("b.n")
    rows = split.select(page, "block", F.when(F.col("v"), -key).otherwise(key).alias("key"), "band", F.explode("b.items").alias("i"))
    order = Window.partitionBy(page).orderBy("block", "key", "band", "i.l", "i.idx")
    ranked = rows.select(page, F.col("i.idx").alias("det_idx"), (F.row_number().over(order) - 1).alias("reading_order"))
    return boxes.join(ranked, [page, "det_idx"])
