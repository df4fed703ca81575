"""Best-fit packing of documents into training sequences of several permitted lengths.

Lengths are whole numbers up to the longest permitted sequence, so the whole corpus is described by a histogram of fixed
size. Best-fit-decreasing is computed once over that histogram, placing equal pieces in runs instead of one by one: the
result is that of packing all pieces of the corpus together, however large it is. The pieces are then dealt to the
places by their rank among pieces of equal length. Ranks are counted in slices of the hash of the row, so that a
length that a third of all pieces share is not ranked in one task.

* Best fit: a piece goes to the open bin that it leaves fullest.
* Opening: when no open bin has room, the bin size is opened that costs least per token it can be expected to hold,
  given what smaller pieces are left.
* Downsizing: at the end each bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from .common import WORD_PATTERN, fresh, text_of, written

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Rows of one length that are ranked together, about; of a length with many rows, as many as there are such slices.
SLICE_ROWS = 250
#: Copies of a row that are dealt together.
COPY_ROWS = 256


def linear_cost(capacity: int, overhead: int = 64, quadratic: float = 1 / 16384) -> float:
    """Cost of a sequence: its tokens, a fixed part, and attention that grows with the square."""
    return overhead + capacity + quadratic * capacity * capacity


@dataclass
class Layout:
    """Where pieces go. Places: (length, rank from, rank to, bin of the first, pieces per bin, offset in the bin)."""

    places: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    #: Runs of equal bins: (first, end, used).
    bins: list[tuple[int, int, int]] = field(default_factory=list)


def best_fit(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost=linear_cost) -> Layout:
    """Pack a histogram of piece lengths (1 to the largest capacity).

    Work grows with the number of distinct lengths and runs of equal bins, not with the number of pieces. Ties go to the
    bins opened first.
    """
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    lengths = np.zeros(largest + 1, np.int64)
    for s, n in histogram.items():
        if not 1 <= s <= largest:
            raise ValueError(f"a piece of {s} does not fit {largest}")
        lengths[s] = n
    mass = np.cumsum(lengths * np.arange(largest + 1))  # tokens of pieces up to each length
    layout, next_bin = Layout(), 0
    room: list[int] = []  # residual capacities with open runs, ascending
    runs: dict[int, list[tuple[int, int, int]]] = {}  # residual -> (first bin, end, capacity)

    def put(residual: int, run: tuple[int, int, int]) -> None:
        if run[0] == run[1]:
            return
        if residual not in runs:
            runs[residual] = []
            insort(room, residual)
        runs[residual].append(run)

    def fill(s: int, rank: int, n: int, residual: int, run: tuple[int, int, int]) -> int:
        """Place pieces of one length into a run of equal bins; returns how many were placed."""
        first, end, capacity = run
        per = residual // s
        full = min(end - first, n // per)
        if full:
            layout.places.append((s, rank, rank + full * per, first, per, capacity - residual))
            put(residual - per * s, (first, first + full, capacity))
        done, at = full * per, first + full
        part = n - done
        if at < end and part:
            layout.places.append((s, rank + done, rank + n, at, part, capacity - residual))
            put(residual - part * s, (at, at + 1, capacity))
            done, at = n, at + 1
        put(residual, (at, end, capacity))
        return done

    for s in np.flatnonzero(lengths)[::-1].tolist():
        rank, n = 0, int(lengths[s])
        while n:
            k = bisect_left(room, s)
            if k < len(room):
                residual = room[k]
                run = runs[residual].pop(0)
                if not runs[residual]:
                    del runs[residual]
                    room.pop(k)
                done = fill(s, rank, n, residual, run)
            else:
                # what one bin can be expected to hold: pieces of this length, then smaller ones that fit beside them
                def rate(c: int, n: int = n, s: int = s) -> float:
                    own = min(c // s, n) * s
                    return cost(c) / (own + min(c - own, int(mass[min(s - 1, c - own)])))

                capacity = min((c for c in capacities if c >= s), key=lambda c: (rate(c), c))
                bins = max(1, n // (capacity // s))
                done = fill(s, rank, min(n, bins * (capacity // s)), capacity, (next_bin, next_bin + bins, capacity))
                next_bin += bins
            rank, n = rank + done, n - done
    for residual, own in runs.items():
        layout.bins += [(a, b, c - residual) for a, b, c in own]
    layout.bins.sort()
    return layout


def split_at_bins(layout: Layout, capacities: tuple[int, ...]) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Places cut so that each lies in one run of equal bins, with the bins' contents and downsized capacity."""
    starts = [a for a, _, _ in layout.bins]
    fits = sorted(capacities)
    out = []
    for s, lo, hi, first, per, offset in layout.places:
        last = first + (hi - lo - 1) // per
        k = bisect_left(starts, first + 1) - 1
        while k < len(starts) and starts[k] <= last:
            a, b, used = layout.bins[k]
            begin = max(first, a)
            end = min(last + 1, b)
            out.append((s, lo + (begin - first) * per, min(hi, lo + (end - first) * per), begin, per, offset, used, fits[bisect_left(fits, used)]))
            k += 1
    return out


def word_length(text: str = "text") -> Column:
    """Default length of a document: its words and one end mark."""
    return F.regexp_count(text_of(text), F.lit(WORD_PATTERN)).cast("long") + 1


def pack(docs: DataFrame, length: Column, keep: tuple[str, ...] = ("doc_id",), capacities: tuple[int, ...] = CAPACITIES, cost=linear_cost) -> DataFrame:
    """One row per piece: the columns ``keep``, then ``piece``, ``piece_start``, ``piece_length``, ``bin_id``,
    ``bin_offset``, ``bin_used``, ``bin_capacity`` (new names where ``keep`` has these, compared without case).

    A document longer than the largest capacity is cut into pieces of that capacity and a rest. Null lengths count as 0;
    documents of length 0 or less have no piece and no row. Repeated rows are packed each; they are counted before they
    are dealt, and dealt in runs of ``COPY_ROWS``, so that they do not meet in one task. Equal pieces are dealt in the
    order of the row's hash, so the result does not depend on partitioning; it is the same for the same rows. An empty
    table gives an empty table.
    """
    largest = max(capacities)
    names = list(keep) + fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "piece", "piece_start", "piece_length", *PLACED.names)
    own = [f"k{i}" for i in range(len(keep))]  # inside, no name of the caller is used
    n, row = F.col("words"), F.col("row")
    sized = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)], F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("words"))
    counted = sized.where(n > 0).groupBy(*own, "words").agg(F.count("*").alias("copies"))
    told = [x for k in own for x in (F.col(k).isNull(), F.col(k).cast("string"))]
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPY_ROWS))))
    runs = runs.withColumn("copies", F.least(F.col("copies") - F.col("run") * COPY_ROWS, F.lit(COPY_ROWS).cast("long"))).withColumn("row", F.xxhash64(*told, n, F.col("run")))
    cuts = F.sequence(F.lit(0), F.floor((n - 1) / largest)).cast("array<int>")
    pieces = (
        runs.withColumn("piece", F.explode(cuts))
        .withColumn("piece_start", F.col("piece") * F.lit(largest).cast("long"))
        .withColumn("piece_length", F.least(n - F.col("piece_start"), F.lit(largest)).cast("int"))
        .drop("words")
    )
    pieces = written(pieces, "pieces")
    tally = pieces.groupBy("piece_length").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).collect()
    counts = {r["piece_length"]: r["n"] for r in tally}
    places = split_at_bins(best_fit(counts, capacities, cost), capacities)
    # rank within a length: slices by row hash, numbered within each slice, offset by the slices before
    width = {r["piece_length"]: int(r["rows"] / max(SLICE_ROWS, isqrt(r["rows"]))) + 1 for r in tally}
    widths = F.split(F.lit(",".join(str(width.get(s, 1)) for s in range(largest + 1))), ",").cast("array<int>")
    share = (row / F.lit(float(1 << 63)) + 1) / 2
    cut = pieces.withColumn("slice", F.floor(share * F.get(widths, F.col("piece_length"))).cast("int"))
    copies = F.col("copies")
    inside = Window.partitionBy("piece_length", "slice").orderBy("row", "run", "piece", *own)
    local = cut.withColumn("local", F.sum(copies).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - copies)
    sizes = cut.groupBy("piece_length", "slice").agg(F.sum("copies").alias("n"))
    before = sizes.select("piece_length", "slice", (F.sum("n").over(Window.partitionBy("piece_length").orderBy("slice")) - F.col("n")).alias("before"))
    ranked = local.join(before, ["piece_length", "slice"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local") + F.col("copy"))
    return ranked.withColumn("at", placed(places)(F.col("piece_length"), F.col("rank"))).select(*own, "piece", "piece_start", "piece_length", "at.*").toDF(*names)


PLACED = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("bin_offset", T.LongType()), T.StructField("bin_used", T.IntegerType()), T.StructField("bin_capacity", T.IntegerType())])


def placed(places: list[tuple[int, ...]]):
    """Look up the place of a piece by its length and rank. The table's size depends on the permitted lengths alone."""
    rows = np.array(sorted(places), np.int64).reshape(-1, 8)
    keys = rows[:, 0] << 48 | rows[:, 1]

    @arrow_udf(PLACED)
    def look_up(length: pa.Array, rank: pa.Array) -> pa.Array:
        s, r = length.to_numpy().astype(np.int64), rank.to_numpy().astype(np.int64)
        own = rows[np.searchsorted(keys, s << 48 | r, side="right") - 1]
        inner, per = r - own[:, 1], np.maximum(own[:, 4], 1)
        parts = [own[:, 3] + inner // per, own[:, 5] + inner % per * s, own[:, 6].astype(np.int32), own[:, 7].astype(np.int32)]
        return pa.StructArray.from_arrays([pa.array(x) for x in parts], PLACED.names)

    return look_up
