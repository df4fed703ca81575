"""Benchmark records: fingerprints, comparison of runs, baselines, and JSON and CSV files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from quire.plans.config import Options

SCHEMA_VERSION, PIPELINE_VERSION = 2, "quire"
METRICS = ("cer", "exact_rate", "recall", "precision", "f1", "order_accuracy", "empty_rate", "error_detection_rate")

# The fields of a line that count for its fingerprint, with the default of a missing one.
LINE_FIELDS = (
    ("id", "''"), ("text", "null"), ("region", "null"), ("detectionIndex", "null"), ("readingOrder", "null"), ("detectionScore", "null"), ("recognitionScore", "null"),
    ("minimumTokenScore", "null"), ("meanTokenMargin", "null"), ("eosScore", "null"), ("endedWithEos", "null"), ("source", "null"), ("preprocessing", "null"),
    ("orientation", "null"), ("deskewAngle", "null"), ("paperScore", "null"), ("uncertain", "false"), ("selectionReason", "null"), ("alternatives", "array()"),
)

# The columns of the CSV file, in order.
CSV_COLUMNS = (
    "schemaVersion", "pipelineVersion", "createdAt", "modelRevision", "browser", "provider", "modelInferenceCount", "maxCanvasPixels", "profile", "manifestUrl", "canvasId",
    "lineIndex", "lineId", "readingOrder", "text", "detectionScore", "recognitionScore", "minimumTokenScore", "meanTokenMargin", "eosScore", "endedWithEos", "source",
    "preprocessing", "orientation", "deskewAngle", "paperScore", "cer", "exactLineRate", "detectionRecall", "detectionPrecision", "detectionF1", "readingOrderAccuracy",
    "emptyRate", "lowConfidenceErrorDetectionRate",
)


def lines_fingerprint(lines: Column, fields: list[str]) -> Column:
    """JSON of the counted fields of an array of lines, nulls included; ``fields`` names those that the lines have."""
    value = lambda x, name, default: F.coalesce(x[name], F.expr(default)) if name in fields and default not in ("null", "array()") else x[name] if name in fields else F.expr(default)
    shown = F.transform(lines, lambda x: F.struct(*[value(x, n, d).alias(n) for n, d in LINE_FIELDS]))
    return F.to_json(shown, {"ignoreNullFields": "false"})


def record_fingerprint(record: DataFrame) -> Column:
    """Fingerprint of a run's record without what differs from run to run: time, engine and statistics.

    Fields are declared in the order of their names, so equal contents give equal JSON.
    """
    kept = sorted(c for c in record.columns if c not in ("createdAt", "browser", "stats", "lines"))
    return F.sha2(F.to_json(F.struct(*kept)), 256)


def last_of(records: DataFrame, key: str, position: str | None) -> DataFrame:
    """One record per key: the last by position."""
    if position is None:
        return records
    order = Window.partitionBy(key).orderBy(F.col(position).desc())
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def differing(first: DataFrame, second: DataFrame, fingerprint: Column, key: str = "canvas_id", position: str | None = None) -> DataFrame:
    """Keys whose records differ between two runs or that one run lacks: key and ``why``; none means deterministic."""
    a = last_of(first, key, position).select(key, fingerprint.alias("a"), F.lit(True).alias("in_a"))
    b = last_of(second, key, position).select(key, fingerprint.alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    why = F.when(F.col("in_a").isNull(), "missing in first").when(F.col("in_b").isNull(), "missing in second").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return both.select(key, why.alias("why")).where("why is not null")


def baseline_deltas(baseline: DataFrame, candidate: DataFrame, key: str = "canvas_id", position: str | None = None) -> DataFrame:
    """Change of each metric from a baseline to a candidate, for keys of both whose records have metrics.

    Of repeated keys in the candidate the last by position counts; the baseline's stay.
    """
    a = baseline.where("metrics is not null").select(key, F.col("metrics").alias("a"))
    b = last_of(candidate, key, position).where("metrics is not null").select(key, F.col("metrics").alias("b"))
    return a.join(b, key).select(key, *[(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(m) for m in METRICS])


def create_baseline(records: DataFrame, created_at: Column, position: str = "position") -> DataFrame:
    """One baseline record of a run: its records in order, with model and pipeline of the first.

    A baseline file is one document by definition; keep larger runs as tables.
    """
    row = F.struct(position, *[c for c in records.columns if c != position])
    return records.agg(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit("ocr-baseline").alias("kind"), F.min(created_at).alias("createdAt"),
        F.coalesce(F.min_by("modelRevision", position), F.lit("unknown")).alias("modelRevision"), F.coalesce(F.min_by("pipelineVersion", position), F.lit("unknown")).alias("pipelineVersion"),
        F.array_sort(F.collect_list(row)).alias("records"),
    )


def number(value: Column) -> Column:
    """A double as JavaScript writes it: no ``.0``, decimals from 1e-6 to 1e21, else ``1e-7``; null stays null."""
    plain = value.cast("string")
    whole = F.regexp_replace(plain, r"\.0$", "")
    wide = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,17)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    size = F.abs(value)
    return F.when(~plain.contains("E"), whole).when((size >= 1e-6) & (size < 1e21), wide).otherwise(short)


def _json(value, pad: str = "") -> str:
    """Two blanks a level, numbers as JavaScript writes them, empty arrays and objects closed at once."""
    deep = pad + "  "
    if isinstance(value, dict):
        inner = [f"{deep}{json.dumps(k, ensure_ascii=False)}: {_json(v, deep)}" for k, v in value.items()]
        return "{\n" + ",\n".join(inner) + f"\n{pad}}}" if inner else "{}"
    if isinstance(value, list):
        inner = [deep + _json(v, deep) for v in value]
        return "[\n" + ",\n".join(inner) + f"\n{pad}]" if inner else "[]"
    if isinstance(value, float):
        if value == int(value) and abs(value) < 1e21:
            return str(int(value))
        digits = repr(value)
        if "e" in digits and 1e-6 <= abs(value) < 1e21:
            return format(Decimal(digits), "f")
        return re.sub(r"e([+-])0*", r"e\1", digits)
    return json.dumps(value, ensure_ascii=False)


def json_lines(frame: DataFrame) -> DataFrame:
    """One JSON document per row, indented by two blanks and ended by a newline, for a text sink; fields of null are left out."""

    @arrow_udf(T.StringType())
    def pretty(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([_json(json.loads(r)) + "\n" for r in rows.to_pylist()], pa.string())

    return frame.select(pretty(F.to_json(F.struct("*"))).alias("value"))


def engine_name(engine: str | None = None) -> str:
    """What the record names as the engine that ran: as given, else this Spark."""
    import pyspark

    return engine or f"pyspark/{pyspark.__version__}"


def record(pages: DataFrame, lines: DataFrame, options: Options, metrics: DataFrame | None = None, key: str = "canvasId", engine: str | None = None) -> DataFrame:
    """One benchmark record per page: schemaVersion, pipelineVersion, createdAt, modelRevision, page, execution, output and
    ``metrics`` (null where the page has no ground truth).

    ``pages``: the key and, as far as known, manifestUrl, imageServiceId, width, height, imageWidth, imageHeight,
    pipelineVersion, modelRevision, provider and stats; image sizes fall back to the page's, names to "unknown".
    ``lines``: the key, readingOrder and the fields of a line. A page without lines has an empty output. ``metrics``: the
    key and the columns of :func:`quire.operators.evaluate.page_metrics`.
    """
    have = set(pages.columns)
    known = lambda c, kind, default=None: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have else F.lit(default).cast(kind)
    fields = [c for c in lines.columns if c != key]
    first = [c for c in ("readingOrder", "detectionIndex", "id") if c in fields]
    line = F.struct(*[F.col(c) for c in (*first, *[c for c in fields if c not in first])])
    kind = lines.select(line.alias("l")).schema["l"].dataType.simpleString()
    gathered = lines.select(F.col(key), line.alias("l")).groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("lines"))
    rows = pages.join(gathered, key, "left")
    own = F.coalesce(F.col("lines"), F.expr(f"cast(array() as array<{kind}>)"))
    if metrics is not None:
        shown = F.struct(*[F.col(c) for c in metrics.columns if c != key])
        rows = rows.join(metrics.select(key, shown.alias("metrics")), key, "left")
    execution = [F.lit(engine_name(engine)).alias("browser"), known("provider", "string", "unknown").alias("provider"), F.lit(options.profile).alias("profile"), F.lit(options.stable_json()).alias("options")]
    execution += [F.col("stats")] if "stats" in have else []
    size = lambda c, page: F.coalesce(known(c, "double"), known(page, "double"))
    out = F.struct(size("imageWidth", "width").alias("imageWidth"), size("imageHeight", "height").alias("imageHeight"), lines_fingerprint(own, fields).alias("fingerprint"), own.alias("lines"))
    return rows.select(
        key, F.lit(SCHEMA_VERSION).alias("schemaVersion"), known("pipelineVersion", "string", PIPELINE_VERSION).alias("pipelineVersion"), F.current_timestamp().alias("createdAt"),
        known("modelRevision", "string", "unknown").alias("modelRevision"),
        F.struct(known("manifestUrl", "string").alias("manifestUrl"), F.col(key).alias("canvasId"), known("imageServiceId", "string").alias("imageServiceId"), known("width", "double").alias("width"), known("height", "double").alias("height")).alias("page"),
        F.struct(*execution).alias("execution"), out.alias("output"), *([F.col("metrics")] if metrics is not None else []),
    )


def csv_field(value: Column, double: bool = False) -> Column:
    """A CSV field: quoted only with a quote, comma or newline inside; null is empty; doubles as JavaScript writes them."""
    s = F.coalesce(number(value) if double else value.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(lines: DataFrame) -> Column:
    """The CSV row of a line; columns of the file that the table lacks are empty."""
    have = {f.name: f.dataType.simpleString() for f in lines.schema}
    return F.concat_ws(",", *[csv_field(F.col(c), have[c] in ("double", "float")) if c in have else csv_field(F.lit(None)) for c in CSV_COLUMNS])


def write_csv(lines: DataFrame, path: str, order: str = "lineIndex") -> None:
    """Write one record's lines as a CSV file with a header, in order. A record is one page, so it is one partition."""
    spark = lines.sparkSession
    header = spark.createDataFrame([(-1, ",".join(CSV_COLUMNS))], "o long, value string")
    rows = header.unionByName(lines.select(F.col(order).cast("long").alias("o"), csv_row(lines).alias("value")))
    rows.coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def export_name(kind: Column, record_id: Column, page: Column) -> Column:
    """File name of an export."""
    return F.concat_ws("-", kind, record_id, page.cast("string"))
