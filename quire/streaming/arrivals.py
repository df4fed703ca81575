"""Evaluation of results as they arrive: a stream of files, each micro-batch through the batch evaluator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream over Parquet files dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def evaluate_arrivals(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write ``evaluate(batch)`` of every micro-batch, once: a batch's folder is overwritten if the batch is repeated."""

    def one(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
