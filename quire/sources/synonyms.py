"""Dictionary of variant characters from an SQL dump of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how a statement of the dump begins.
STATEMENT = "INSERT INTO synonyms VALUES ("
LEAST_PAIRS = 1000


def read_synonyms(spark: SparkSession, path: str, least: int = LEAST_PAIRS) -> DataFrame:
    """Entries (entry_idx, normalized, variants) of a dump, in order of first appearance; variants distinct, in order.

    A statement has a line of its own and two values that are not empty. Raises if the dump has fewer than ``least`` pairs. The order is that of lines, so a dump is one file; dumps are small.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    # a doubled quote inside a value is set aside, so that the others part the statement: head, value, comma, value, tail
    part = lambda k: F.replace(F.get(F.col("parts"), k), F.lit("\0"), F.lit("'"))
    told = lines.where(F.startswith("value", F.lit(STATEMENT))).withColumn("parts", F.split(F.replace(F.col("value"), F.lit("''"), F.lit("\0")), "'"))
    rows = told.where((F.size("parts") == 5) & (part(0) == STATEMENT) & (part(2) == ", ") & (part(4) == ");")).select("line", part(1).alias("variant"), part(3).alias("normalized"))
    n = rows.count()
    if n < least:
        raise ValueError(f"{n} pairs; at least {least} were expected")
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line", "variant"))), lambda x: x["variant"]))
    return rows.groupBy("normalized").agg(F.min("line").alias("entry_idx"), ordered.alias("variants")).select("entry_idx", "normalized", "variants")
