"""Helpers shared by the operators: text access, tokens, bounded samples and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and the controls U+0009 to U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """One column name per stem that ``df`` does not have, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in taken:
            n += 1
            name = f"{stem}{n}"
        taken.add(name.lower())
        out.append(name)
    return out


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, read from the session.

    Where it is unset, a temporary folder is made once if all runs in one process (``local`` master); on a cluster, whose
    machines do not share such a folder, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = f"file://{tempfile.mkdtemp(prefix='quire-scratch-')}"
        root = _own["dir"]
    return root.rstrip("/")


#: Rows of keys that may be broadcast, each of a few dozen bytes; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def chosen(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a written table of keys, which is broadcast if it is small enough; then ``df`` is not shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a whole row, which tell nulls in different columns apart."""
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit("second"), *parts)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs only the tasks it was running, and later actions reuse the rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a table made by :func:`written`, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def batch_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null as empty."""
    return pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()


def flat_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch in order, and how many belong to each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    # a leading or trailing space would give an empty piece
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    keep = np.asarray(pc.binary_length(flat)) > 0
    if not keep.all():
        owner = np.repeat(np.arange(len(sizes)), sizes)[keep]
        flat, sizes = flat.filter(pa.array(keep)), np.bincount(owner, minlength=len(sizes)).astype(np.int64)
    return flat, sizes


def slices(texts: pa.Array, limit: int = 8 << 20) -> Iterator[pa.Array]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes, to bound working memory."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
