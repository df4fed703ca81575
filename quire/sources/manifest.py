"""Page manifests (IIIF presentation JSON, versions 2 and 3) as tables of manifests and pages."""

from __future__ import annotations

import json
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

UNTITLED = "無題のIIIF資料"
_SKIP = {"@id", "id", "type", "@type"}


def localized(value, language: str = "none", out: dict[str, str] | None = None) -> dict[str, str]:
    """Texts by language of any localised value: string, list, ``@value`` object or language map; the first text wins."""
    out = {} if out is None else out
    if isinstance(value, str):
        if not out.get(language):
            out[language] = value
    elif isinstance(value, list):
        for item in value:
            localized(item, language, out)
    elif isinstance(value, dict):
        literal = value["@value"] if value.get("@value") is not None else value.get("value")
        if isinstance(literal, str):
            own = value.get("@language")
            own = language if own is None else str(own)
            if not out.get(own):
                out[own] = literal
        else:
            for key, item in value.items():
                if key not in _SKIP:
                    localized(item, key, out)
    return out


@arrow_udf(T.MapType(T.StringType(), T.StringType()))
def localized_texts(values: pa.Array) -> pa.Array:
    """JSON of a localised value -> map of language to text. The nesting is unbounded, so this is not an expression."""
    rows = []
    for text in values.to_pylist():
        try:
            rows.append(list(localized(json.loads(text)).items()) if text is not None else [])
        except ValueError:
            rows.append([])
    return pa.array(rows, pa.map_(pa.string(), pa.string()))


def pick_text(texts: Column, locale: str) -> Column:
    """The text of a locale, else of no language, Japanese, English, or the first; empty without any."""
    at = lambda k: F.try_element_at(texts, F.lit(k))
    return F.coalesce(at(locale), at("none"), at("ja"), at("en"), F.get(F.map_values(texts), F.lit(0)), F.lit(""))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(v: Column, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*[_get(v, p, kind) for p in paths])


def _json(v: Column, *paths: str) -> Column:
    return F.to_json(F.coalesce(*[F.try_variant_get(v, p, "variant") for p in paths]))


def service_address(body: Column) -> Column:
    """Address of the first service of an image body, without one trailing slash; empty if there is none."""
    return F.coalesce(F.regexp_replace(_first(body, "$.service[0].id", "$.service[0]['@id']", "$.service.id", "$.service['@id']"), "/$", ""), F.lit(""))


def sized(service: Column, fallback: Column, width: int) -> Column:
    return F.when(F.length(service) > 0, F.concat(service, F.lit(f"/full/{width},/0/default.jpg"))).otherwise(fallback)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files, one per row: ``source_url`` and ``raw``. Fetching over HTTP is left to the ingestion before."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_url"), F.col("value").alias("raw"))


def valid_address(url: Column) -> Column:
    """Trimmed address if it is https, else null."""
    return F.when(F.trim(url).rlike("^https://[^/]+"), F.trim(url))


def parse_manifests(raw: DataFrame, locale: str = "ja") -> tuple[DataFrame, DataFrame]:
    """Tables of manifests and of pages from rows (source_url, raw).

    Canvases come from the first sequence (version 2) or the items (version 3). A canvas with neither service nor image is
    left out and the others keep their number. ``error`` is set for unreadable JSON and for manifests without pages.
    """
    m = raw.select("source_url", F.try_parse_json("raw").alias("v"))
    canvases = F.coalesce(F.try_variant_get("v", "$.sequences[0].canvases", "array<variant>"), F.try_variant_get("v", "$.items", "array<variant>"))
    c = m.select("source_url", F.posexplode(canvases).alias("i", "c"))
    body = F.coalesce(*[F.try_variant_get("c", p, "variant") for p in ("$.images[0].resource", "$.items[0].items[0].body")])
    c = c.withColumn("b", body).withColumns({
        "image_service_id": F.coalesce(service_address(F.col("b")), F.lit("")),
        "original": F.coalesce(_first(F.col("b"), "$.id", "$['@id']"), _first(F.col("c"), "$.thumbnail[0].id", "$.thumbnail.id"), F.lit("")),
        "texts": localized_texts(_json(F.col("c"), "$.label")),
    })
    number = (F.col("i") + 1).cast("string")
    label = pick_text(F.col("texts"), locale)
    pages = c.where((F.col("image_service_id") != "") | (F.col("original") != "")).select(
        "source_url", F.col("i").alias("canvas_index"),
        F.coalesce(_first(F.col("c"), "$.id", "$['@id']"), F.concat("source_url", F.lit("#canvas-"), number)).alias("canvas_id"),
        "image_service_id", F.when(label != "", label).otherwise(number).alias("label"),
        F.when(F.size("texts") > 0, F.col("texts")).otherwise(F.create_map(F.lit("none"), number)).alias("label_translations"),
        sized(F.col("image_service_id"), F.col("original"), 1200).alias("image"), sized(F.col("image_service_id"), F.col("original"), 180).alias("thumbnail"),
        *[F.coalesce(_get(F.col("c"), f"$.{d}", "double"), _get(F.col("b"), f"$.{d}", "double"), F.lit(0.0)).alias(d) for d in ("width", "height")],
    )

    @arrow_udf(T.StringType())
    def host(urls: pa.Array) -> pa.Array:
        return pa.array([None if u is None else urlparse(u).hostname or "" for u in urls.to_pylist()], pa.string())

    v = F.col("v")
    url = F.coalesce(_first(v, "$.id", "$['@id']"), F.col("source_url"))
    rights = F.coalesce(_get(v, "$.rights[0]"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.rights", "variant")).startswith("ARRAY"), F.lit("")), _get(v, "$.rights"), _get(v, "$.license"), F.lit(""))
    named = m.withColumns({"title_translations": localized_texts(_json(v, "$.label")), "attribution_translations": localized_texts(_json(v, "$.requiredStatement.value", "$.attribution"))})
    title, owner = pick_text(F.col("title_translations"), locale), pick_text(F.col("attribution_translations"), locale)
    counts = pages.groupBy("source_url").agg(F.count("*").alias("n_pages"))
    manifests = named.join(counts, "source_url", "left").select(
        "source_url", url.alias("url"), F.when(title != "", title).otherwise(F.lit(UNTITLED)).alias("title"),
        F.when(F.size("title_translations") > 0, F.col("title_translations")).otherwise(F.create_map(F.lit("none"), F.lit(UNTITLED))).alias("title_translations"),
        F.when(owner != "", owner).otherwise(host("source_url")).alias("attribution"), rights.alias("license"),
        F.coalesce(F.nullif(_get(v, "$.viewingDirection"), F.lit("")), F.lit("right-to-left")).alias("viewing_direction"),
        F.coalesce(F.nullif(F.regexp_extract(url, r"/biblio/(\d+)", 1), F.lit("")), F.lit("EXTERNAL")).alias("record_id"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        F.when(v.isNull(), "not JSON").when(F.col("n_pages").isNull(), "no pages").alias("error"),
    )
    return manifests, pages


def requests(pages: DataFrame, manifests: DataFrame, era_profile: str) -> DataFrame:
    """One recognition request per page."""
    return pages.join(manifests.select("source_url", F.col("url").alias("manifest_id")), "source_url").select(
        "manifest_id", "canvas_id", "image_service_id", F.lit(era_profile).alias("era_profile"), F.lit("iiif-annotation-page").alias("output")
    )


def initial_page(pages: DataFrame, visits: DataFrame) -> DataFrame:
    """First page to show of each visit (source_url, visit_id, canvas_number, previous_canvas_id, stored_canvas_id).

    A valid canvas number wins, then the first page of the previous canvas, then of the stored one, then page 0. Pages
    count in their order among the manifest's pages.
    """
    from pyspark.sql.window import Window

    place = pages.select("source_url", "canvas_id", (F.row_number().over(Window.partitionBy("source_url").orderBy("canvas_index")) - 1).alias("at"))
    first = place.groupBy("source_url", "canvas_id").agg(F.min("at").alias("at"))
    n = place.groupBy("source_url").agg(F.count("*").alias("n"))
    by = lambda name: first.select("source_url", F.col("canvas_id").alias(f"{name}_canvas_id"), F.col("at").alias(name))
    out = visits.join(n, "source_url", "left").join(by("previous"), ["source_url", "previous_canvas_id"], "left").join(by("stored"), ["source_url", "stored_canvas_id"], "left")
    number = F.when((F.col("canvas_number") >= 1) & (F.col("canvas_number") <= F.col("n")), F.col("canvas_number") - 1)
    return out.select("source_url", "visit_id", F.coalesce(number, "previous", "stored", F.lit(0)).cast("int").alias("page_index"))


def manifest_url_of_path(path: Column, template: str, base: str = "") -> Column:
    """Manifest address of an application path ``/<number>``; null for other paths. ``template`` has ``{id}``."""
    number = F.regexp_extract(path, f"^{base}/(\\d+)/?$", 1)
    before, after = template.split("{id}")
    return F.when(number != "", F.concat(F.lit(before), number, F.lit(after)))


def path_of_manifest_url(url: Column, template: str, base: str = "", canvas: Column | None = None) -> Column:
    """The inverse: an application path, with ``?canvas=`` for a positive number; the root for other addresses."""
    import re

    before, after = (re.escape(x) for x in template.split("{id}"))
    number = F.regexp_extract(url, f"^{before}(\\d+){after}/?$", 1)
    path = F.when(number != "", F.concat(F.lit(f"{base}/"), number)).otherwise(F.lit(f"{base}/"))
    return path if canvas is None else F.when(canvas > 0, F.concat(path, F.lit("?canvas="), canvas.cast("long").cast("string"))).otherwise(path)


def canvas_number(value: Column) -> Column:
    """A positive whole number without leading zeros, below 2^53; else null."""
    return F.when(value.rlike("^[1-9][0-9]{0,15}$") & (F.try_to_number(value, F.lit("9" * 16)) <= 9007199254740991), value.cast("long"))
