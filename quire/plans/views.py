"""Page-shaped views over the star-schema tables, on which the queries run.

Boxes come from ``lineitem`` in pages of sixteen orders, so the number of pages grows with the data and the size of a page
does not. A box's index is its place in the page by the columns that the view reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    page = F.floor(F.col("l_orderkey") / 16).cast("long")
    order = Window.partitionBy("page_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.withColumn("page_id", page).select(
        "page_id",
        (F.row_number().over(order) - 1).cast("long").alias("det_idx"),
        (F.col("l_partkey") % 400).cast("double").alias("x"),
        ((F.col("l_suppkey") * 37) % 600).cast("double").alias("y"),
        (F.lit(10) + F.col("l_quantity")).cast("double").alias("width"),
        (F.lit(10) + (F.col("l_partkey") * 7) % 60).cast("double").alias("height"),
        (((F.col("l_partkey") * 13 + F.col("l_suppkey")) % 97) / F.lit(97.0)).alias("score"),
    )


def truths(boxes: DataFrame) -> DataFrame:
    """Every third box, shifted; every ninth far away, so that it is missed. ``boxes``: :func:`detections`."""
    order = Window.partitionBy("page_id").orderBy("det_idx")
    far = F.when(F.col("det_idx") % 9 == 0, 5000.0).otherwise(1.0)
    kept = boxes.where(F.col("det_idx") % 3 == 0)
    return kept.select(
        "page_id", (F.row_number().over(order) - 1).cast("long").alias("ref_idx"), "det_idx",
        (F.col("x") + 2).alias("x"), (F.col("y") + far).alias("y"), "width", "height",
        F.concat(F.lit("line "), (F.col("det_idx") % 7).cast("string"), F.lit(" of the page")).alias("text"),
    )


def predictions(boxes: DataFrame) -> DataFrame:
    return boxes.select(
        "page_id", F.col("det_idx").alias("pred_idx"), "x", "y", "width", "height",
        F.when(F.col("det_idx") % 13 == 5, F.lit("  ")).otherwise(F.concat(F.lit("line "), (F.col("det_idx") % 5).cast("string"), F.lit(" of the page"))).alias("text"),
        F.col("score").alias("recognition_score"), (F.col("det_idx") % 11 != 0).alias("ended_with_eos"), (F.col("det_idx") * 7 % 101).alias("reading_order"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their whole texts: doc_id, t, n_chars; a null text counts as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "n_chars")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Partitioned by ``key`` over all cores: distances of whole texts are long work on few bytes, which adaptive execution
    would put into one task. Later groups and windows by the key need no other exchange."""
    session = frame.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return frame.repartition(n, key)


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text with the next one of its block of 100 ids: doc_id, a, b."""
    blocks = spread(texts(spark, sf_dir).withColumn("block", F.floor(F.col("doc_id") / 100)), "block")
    order = Window.partitionBy("block").orderBy("doc_id")
    return blocks.select("doc_id", F.col("t").alias("a"), F.lead("t").over(order).alias("b")).where("b is not null")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three competing readings of every whole line of every document, with scores from their lengths."""
    lines = spread(texts(spark, sf_dir), "doc_id").select("doc_id", F.posexplode(F.split("t", "\n")).alias("line_idx", "line"))
    readings = F.array("line", F.translate("line", "eéио", "cèнe"), F.concat("line", F.lit("~")))
    rows = lines.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), F.posexplode(readings).alias("ord", "text"))
    n, i = F.length("text") + F.col("doc_id"), F.col("ord")
    return rows.select(
        "doc_id", "line_idx", "ord", "text",
        ((n % 89) / F.lit(89.0)).alias("recognition_score"), ((n % 47) / F.lit(47.0)).alias("minimum_token_score"), ((n % 31) / F.lit(10.0)).alias("mean_token_margin"),
        F.when(n % 5 != 0, (n % 23) / F.lit(23.0)).alias("eos_score"), (n % 4 != 0).alias("ended_with_eos"),
        F.lit("page").alias("source"), F.when(i % 2 == 0, "original").otherwise("padded").alias("preprocessing"),
        (F.lit(10) + n % 300).cast("double").alias("width"), (F.lit(5) + i * 7).cast("double").alias("height"),
    )
