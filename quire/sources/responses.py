"""Requests to services and their answers, as tables. Calling the services is left to the ingestion around the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def distinct_requests(requests: DataFrame, url: str = "url") -> DataFrame:
    """One row per address, so that nothing is fetched twice."""
    return requests.where(F.col(url).isNotNull()).dropDuplicates([url])


def classified(answers: DataFrame, body: str = "body", status: str | None = None) -> DataFrame:
    """Columns of ``answers`` with ``predictions`` and ``error``.

    ``predictions`` holds (character, probability) of the pairs of a text and a number in the answer's ``predictions``;
    other pairs are left out. Errors: not JSON, a status other than 2xx (with the answer's own message), no array.
    """
    v = F.try_parse_json(body)
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    rows = answers.withColumn("_v", v).withColumn("_p", F.try_variant_get("_v", "$.predictions", "array<variant>"))
    good = lambda x: F.coalesce((kind(x, "$[0]") == "STRING") & kind(x, "$[1]").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.lit(False))
    pairs = F.transform(F.filter("_p", good), lambda x: F.struct(F.try_variant_get(x, "$[0]", "string").alias("character"), F.try_variant_get(x, "$[1]", "double").alias("probability")))
    failed = F.lit(False) if status is None else ~F.col(status).between(200, 299)
    detail = F.concat(F.lit("failed"), F.coalesce(F.concat(F.lit(": "), F.when(kind(F.col("_v"), "$.error") == "STRING", F.try_variant_get("_v", "$.error", "string"))), F.lit("")))
    error = F.when(F.col("_v").isNull(), "not JSON").when(failed, detail).when(F.col("_p").isNull(), "no predictions")
    return rows.withColumns({"error": error, "predictions": F.when(error.isNull(), pairs)}).drop("_v", "_p")


def viewer_address(base: str, manifest_url: Column, parameter: str = "manifest") -> Column:
    """Address of an external viewer for a manifest."""
    joint = "&" if "?" in base else "?"
    return F.concat(F.lit(f"{base}{joint}{parameter}="), F.url_encode(manifest_url))


def presets(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of known manifests from literal rows: title, detail, detail_en, image_count, url."""
    return spark.createDataFrame(rows, "title string, detail string, detail_en string, image_count int, url string")


def regions_of(pages: DataFrame, page: str = "canvas_id", lines: str = "lines") -> DataFrame:
    """Lines with a region of each page, with their place among all its lines: page, line_index, region."""
    rows = pages.select(page, F.posexplode(lines).alias("line_index", "l"))
    return rows.where("l.region is not null").select(page, "line_index", F.col("l.region").alias("region"))
