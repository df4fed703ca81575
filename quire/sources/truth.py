"""Ground truth files: strict JSON, one page each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = "array<variant>"


def parse_truth(raw: DataFrame, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of rows of JSON. Pages: id, manifest_url, canvas_id, image_service_id, width, height, tags, lines.

    Required: a JSON object with text ``id``, ``manifestUrl``, ``canvasId`` and an array ``lines`` of objects with a text
    and a region of four numbers. Optional fields have defaults; tags count only if all are texts. Rejects keep the raw
    text and say why.
    """
    v = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    is_text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    numeric = "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"
    is_number = lambda k: F.coalesce(k.rlike(numeric), F.lit(False))
    inner = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    good = lambda x: (
        F.coalesce(inner(x, "$.text") == "STRING", F.lit(False))
        & is_number(inner(x, "$.region.x")) & is_number(inner(x, "$.region.y")) & is_number(inner(x, "$.region.width")) & is_number(inner(x, "$.region.height"))
    )
    rows = raw.withColumn("v", v).withColumn("l", F.try_variant_get("v", "$.lines", LINES)).withColumn("t", F.try_variant_get("v", "$.tags", LINES))
    error = (
        F.when(F.col("v").isNull(), "not JSON")
        .when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "not an object")
        .when(F.col("l").isNull(), "lines must be an array")
        .when(~(is_text("$.id") & is_text("$.manifestUrl") & is_text("$.canvasId")), "id, manifestUrl and canvasId are required")
        .when(F.exists("l", lambda x: ~good(x)), "each line requires a text and a region of numbers")
    )
    judged = rows.withColumn("error", error)
    s = lambda path: F.try_variant_get("v", path, "string")
    line = lambda x: F.struct(
        F.try_variant_get(x, "$.text", "string").alias("text"),
        F.when(inner(x, "$.normalizedText") == "STRING", F.try_variant_get(x, "$.normalizedText", "string")).alias("normalized_text"),
        F.struct(*[F.try_variant_get(x, f"$.region.{d}", "double").alias(d) for d in ("x", "y", "width", "height")]).alias("region"),
    )
    tags = F.transform("t", lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")))
    pages = judged.where("error is null").select(
        s("$.id").alias("id"), s("$.manifestUrl").alias("manifest_url"), s("$.canvasId").alias("canvas_id"),
        F.when(is_text("$.imageServiceId"), s("$.imageServiceId")).otherwise(F.lit("")).alias("image_service_id"),
        *[F.when(is_number(kind(f"$.{d}")), F.try_variant_get("v", f"$.{d}", "double")).otherwise(F.lit(0.0)).alias(d) for d in ("width", "height")],
        F.when(F.col("t").isNotNull() & ~F.exists(tags, lambda x: x.isNull()), tags).otherwise(F.expr("cast(array() as array<string>)")).alias("tags"),
        F.transform("l", line).alias("lines"),
    )
    return pages, judged.where("error is not null").select(F.col(text).alias("raw"), "error")


def strict(pages: DataFrame, rejects: DataFrame) -> DataFrame:
    """The pages; reading them fails if there is any reject."""
    bad = rejects.select("error").limit(1).collect()
    if bad:
        raise ValueError(bad[0]["error"])
    return pages


def truth_lines(pages: DataFrame) -> DataFrame:
    """One row per line: canvas_id, ref_idx, text, normalized_text, x, y, width, height."""
    rows = pages.select("canvas_id", F.posexplode("lines").alias("ref_idx", "l"))
    return rows.select("canvas_id", "ref_idx", "l.text", "l.normalized_text", "l.region.*")


def viewer_pages(pages: DataFrame) -> DataFrame:
    """Ground truth pages as pages to recognise."""
    image = F.when(F.col("image_service_id") != "", F.concat(F.regexp_replace("image_service_id", "/$", ""), F.lit("/full/2000,/0/default.jpg"))).otherwise(F.lit(""))
    return pages.select("canvas_id", "manifest_url", "image_service_id", F.col("id").alias("label"), image.alias("image"), image.alias("thumbnail"), "width", "height")
