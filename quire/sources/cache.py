"""Results of pages by content key, in an append-only Parquet table.

A put appends; the latest entry of a key counts. Deleting appends a tombstone, so no data is rewritten; ``compact`` does
that when wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import fnv1a


def cache_key(model: Column, pipeline: Column, manifest_url: Column, canvas_id: Column, service: Column, profile: Column, options_json: Column) -> Column:
    """JSON array of six texts and the hash of the options (JSON with sorted keys)."""
    return F.to_json(F.array(model, pipeline, manifest_url, canvas_id, service, profile, fnv1a(options_json)))


def latest(entries: DataFrame, key: str = "key", at: str = "saved_at", *ties: str) -> DataFrame:
    """The latest entry of each key. Nulls are oldest; ties go to the greatest of ``ties``."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties])
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: Columns that an entry has beside the result.
ENTRY = ("key", "manifest_url", "canvas_id", "image_service_id", "saved_at", "deleted")


def entry_of(results: DataFrame, pages: DataFrame, page: str = "page_id") -> DataFrame:
    """Results with the key columns of their pages (page, key, manifest_url, canvas_id, image_service_id)."""
    return results.join(pages.select(page, *ENTRY[:4]), page)


def result_of(entries: DataFrame) -> DataFrame:
    """Entries without the key columns."""
    return entries.drop(*ENTRY)


class ResultCache:
    def __init__(self, spark: SparkSession, path: str, key: str = "key"):
        self.spark, self.path, self.key = spark, path, key

    def _all(self, schema=None) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(self.path) if schema else self.spark.read.parquet(self.path)
        except Exception as e:  # no table yet counts as empty, as a miss
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def put(self, entries: DataFrame) -> None:
        entries.withColumns({"saved_at": F.current_timestamp(), "deleted": F.lit(False)}).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame | None:
        """Live entries, one per key."""
        rows = self._all()
        return None if rows is None else latest(rows, self.key, "saved_at", "deleted").where("not deleted").drop("deleted")

    def split(self, keys: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """(hits, misses) of a table with the key."""
        live = self.read()
        return (None, keys) if live is None else (keys.join(live, self.key), keys.join(live, self.key, "left_anti"))

    def delete(self, keys: DataFrame) -> None:
        live = self.read()
        if live is not None:
            gone = live.join(keys.select(self.key).distinct(), self.key, "left_semi")
            gone.withColumns({"saved_at": F.current_timestamp(), "deleted": F.lit(True)}).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        live = self.read()
        if live is not None:
            self.delete(live.select(self.key))

    def compact(self, to: str) -> ResultCache:
        """Write the live entries to another path."""
        live = self.read()
        if live is not None:
            live.withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(to)
        return ResultCache(self.spark, to, self.key)
