"""From raw documents to packed training sequences, in five stages over ``documents``.

Every stage but the last returns the columns of its input, so stages can be written, reread and run one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import classify, packing, resemblance, rules, secrets
from quire.llm.common import fresh, written

#: Pages of a lower probability of being good are rejected.
QUALITY = 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    judged = rules.judge(docs, _labels(spark, sf_dir))
    return judged.where(F.col(f"{judged.columns[-1]}.kept")).select(*[f"`{c}`" for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    scored = classify.score(docs, _labels(spark, sf_dir))
    return scored.where(F.col(f"{scored.columns[-1]}.quality") >= QUALITY).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: five-word Jaccard similarity 0.8 or more."""
    return resemblance.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; ``n_chars`` follows the new text where it changes."""
    scanned = secrets.scan(docs)
    spans = F.col(f"{scanned.columns[-1]}.spans")
    (new,) = fresh(scanned, "masked")
    scanned = scanned.withColumn(new, F.when(F.size(spans) > 0, secrets.masked(F.col("text"), spans)))
    out = [
        F.coalesce(F.col(new), F.col("text")).alias("text") if c == "text"
        else F.when(F.col(new).isNull(), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars"
        else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return scanned.select(*out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of the permitted lengths."""
    return packing.pack(docs, packing.word_length("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", pack),
]

#: Learned models and iterated packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
