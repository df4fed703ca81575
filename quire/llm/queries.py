"""Queries over the driver tables, one for each operator of this package, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, licences, lm_score, packing, pieces, rules, secrets, simhash, surrogates, telephony
from .common import text_of, written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.stupid_backoff(docs).select("doc_id", "n_tokens", "n_backoff", "score_micro")


def lm_scoring_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op1_lm_scoring, whose SQL is of order 2, with trigrams and the second step back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.stupid_backoff(docs, order=3).select("doc_id", "n_tokens", "n_backoff", "score_micro")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(text_of("text")).cast("long").alias("n_bytes"))
    kept = written(telephony.store_texts(docs).select("doc_id", "n_bytes", "media"), "media")
    return telephony.describe_media(kept, pcm=False).select("doc_id", "n_bytes", "stored.*")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return secrets.scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, packing.word_length("text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "rules.*")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rounded = [F.round(f"scores.{c}", 6).alias(f"{c}_score") for c in ("content", "meta", "quality")]
    return scored.select("doc_id", *rounded, (F.col("scores.quality") >= 0.5).alias("kept"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shown = lambda c: F.array_join(F.transform(F.col(f"licences.{c}"), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return licences.scan(docs).select(
        "doc_id", shown("licences").alias("licences"), shown("sentences").alias("sentences"), F.size("licences.licences").cast("long").alias("n_licences"), "licences.n_unmatched"
    )


#: The key of the query; a user of the operator passes a secret one.
DEMO_KEY = b"surrogates of the example query"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, DEMO_KEY).select("doc_id", "private.*")


def tokenizer_path() -> str:
    """The 32k BPE piece model of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, tokenizer_path()).select("doc_id", "encoded.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "lm_scoring_trigrams": lm_scoring_trigrams,
    "op2_media_columns": op2_media_columns,
    "op3_secret_scans": op3_secret_scans,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_license_scans": op8_license_scans,
    "op9_pii": op9_pii,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op1_lm_scoring": r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
placed AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words),
pairs AS (
  SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM placed),
uni AS (SELECT w, count(*)::DOUBLE AS c FROM placed GROUP BY w),
bi AS (SELECT p, w, count(*)::DOUBLE AS c FROM pairs WHERE p IS NOT NULL GROUP BY p, w),
total AS (SELECT count(*)::DOUBLE AS n FROM placed),
scored AS (
  SELECT x.doc_id,
         (x.p IS NOT NULL AND bi.c < 2)::BIGINT AS back,
         round(1000000 * CASE WHEN x.p IS NULL THEN ln(u.c / n)
                              WHEN bi.c >= 2 THEN ln(bi.c / pu.c)
                              ELSE ln(CAST(0.4 AS DOUBLE) * u.c / n) END)::BIGINT AS s
  FROM pairs x CROSS JOIN total JOIN uni u ON u.w = x.w
  LEFT JOIN uni pu ON pu.w = x.p LEFT JOIN bi ON bi.p = x.p AND bi.w = x.w)
SELECT d.doc_id, count(s)::BIGINT AS n_tokens, coalesce(sum(back), 0)::BIGINT AS n_backoff,
       coalesce(sum(s), 0)::BIGINT AS score_micro
FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id
""",
}
