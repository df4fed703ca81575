"""SimHash near-duplicate groups, found with the general pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints are linked when at most ``max_distance``
bits differ. To find the links without comparing all pairs:

* the 64 bits are grouped into parts so that correlated bits share a part;
* every part gets its own threshold ``t`` from -1 (not probed) upwards, with ``sum(t + 1) = max_distance + 1``.
  If each probed part differed in more than its ``t`` bits, the total would exceed ``max_distance``, so every
  linked pair agrees within ``t`` bits in some part. A dynamic program over the estimated candidate counts of all
  fingerprints chooses the number of parts and the thresholds;
* fingerprints meet in the buckets of their part values (and of the values within ``t`` bits of them), where the
  full distance is verified;
* a bucket of more than ``bucket_rows`` fingerprints is split by the same principle over the bits that its members
  do not yet share, as often as needed. This is exact: nothing is capped or dropped.

Equal fingerprints are one node throughout, and a bucket emits a spanning forest of its links instead of all pairs,
so a large group of copies costs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import batch_bytes, chosen, discard, fresh, row_keys, text_of, written
from .graph import connected_components

BITS = 64
#: Bytes of one comparison row set against one emitted bucket row, for the cost of a plan.
PAIR_COST, ROW_COST = 1.0, 400.0


def fingerprint_bytes(text: bytes, shingle: int = 4) -> int:
    """The SimHash of one text (UTF-8 bytes) as an unsigned integer.

    A-Z are lower-cased; words are runs of non-space bytes; a bit is 1 if it is set in over half of the XXH64 values
    (seed 42) of the space-joined shingles, repeats included. Fewer words than a shingle: the whole sequence is one
    shingle. No word: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    return majority([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])


def majority(hashes) -> int:
    """The bits that over half of some 64-bit values have; zero of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(column: str = "text", shingle: int = 4):
    """A Column: the fingerprint of a text as a signed long (null text: that of the empty text, zero)."""

    @arrow_udf(T.LongType())
    def simhash64(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint_bytes(t, shingle) for t in batch_bytes(texts)), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return simhash64(text_of(column))


# --- choosing parts and thresholds -------------------------------------------------------------------------------


def bit_moments(prints: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all rows.

    Each task sends one row per cell at most, so the result is of fixed size whatever the input.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(v), 1 << 14):
                bits = np.unpackbits(v[at : at + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, BITS).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS)), pa.array(np.concatenate(([n], total.ravel())))], names=["cell", "n"])

    cells = prints.select(column).mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total, n = np.zeros(BITS * BITS, np.int64), 0
    for cell, count in cells:
        if cell < 0:
            n = count
        else:
            total[cell] = count
    return n, total.reshape(BITS, BITS)


def group_bits(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits (0 is the highest) into ``parts`` of near-equal width, greedily keeping correlated bits together."""
    p = np.diag(joint) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = -(-len(left) // (parts - k))
        sub = corr[np.ix_(left, left)]
        own = [left[int(np.argmax(sub.sum(axis=0)))]]
        while len(own) < width:
            rest = [b for b in left if b not in own]
            own.append(rest[int(np.argmax(corr[np.ix_(own, rest)].sum(axis=0)))])
        out.append(sorted(own))
        left = [b for b in left if b not in own]
    return out


def gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each value, packed."""
    out = np.zeros(len(values), np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((values >> np.uint64(BITS - 1 - b)) & np.uint64(1))
    return out


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(widths: list[int], meetings: list[float], n: int, max_distance: int) -> tuple[float, list[int]]:
    """Thresholds per part with ``sum(t + 1) = max_distance + 1`` of least estimated cost, by dynamic programming.

    ``meetings[i]`` is the number of pairs that agree on part ``i``; with threshold ``t`` the estimate is that number
    times the size of a ball of radius ``t``, and each fingerprint is written once for each value in the ball.
    """

    def cost(i: int, t: int) -> float:
        return 0.0 if t < 0 else ball(widths[i], t) * (ROW_COST * n + PAIR_COST * meetings[i])

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(widths)):
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, ts) in best.items():
            for t in range(-1, min(3, max_distance - spent) + 1):
                to = spent + t + 1
                if to <= max_distance + 1 and (now := c + cost(i, t)) < step.get(to, (float("inf"),))[0]:
                    step[to] = (now, [*ts, t])
        best = step
    return best.get(max_distance + 1, (float("inf"), []))


def plan(prints: DataFrame, column: str, max_distance: int) -> list[tuple[list[int], int]]:
    """The parts and thresholds to probe: ``[(bits, threshold), ...]``, from statistics of all fingerprints."""
    n, joint = bit_moments(prints, column)
    if n < 2:
        return []
    choices = {m: group_bits(n, joint, m) for m in sorted({max_distance + 1, max_distance, max(2, max_distance - 1)}) if m >= 1}

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            for m, groups in choices.items():
                for i, bits in enumerate(groups):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), m * 100 + i)), pa.array(gather(v, bits).view(np.int64))], names=["part", "value"])

    counted = prints.select(column).mapInArrow(values, "part long, value long").groupBy("part", "value").agg(F.count("*").cast("double").alias("n"))
    met = dict(counted.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).collect())
    costs = {}
    for m, groups in choices.items():
        c, ts = allocate([len(g) for g in groups], [met[m * 100 + i] for i in range(m)], n, max_distance)
        if ts:
            costs[m] = (c, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return min(costs.values(), key=lambda x: x[0])[1]


# --- probing and verifying ---------------------------------------------------------------------------------------


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit key from two; two keys that fall together only cost comparisons, as every link is verified."""
    with np.errstate(over="ignore"):
        x = (a ^ (np.asarray(b, np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def first_keys(parts: list[tuple[list[int], int]]):
    """The buckets of each fingerprint: columns key, fp, used (the bits that all members of the bucket share)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            for i, (bits, t) in enumerate(parts):
                value = gather(v, bits)
                used = sum(1 << (BITS - 1 - x) for x in bits) if t == 0 else 0
                for r in range(t + 1):
                    for flip in combinations(range(len(bits)), r):
                        near = value ^ np.uint64(sum(1 << x for x in flip))
                        key = mix(near, i + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(v), used, np.uint64).view(np.int64))], names=["key", "fp", "used"])

    return keys


def child_keys(max_distance: int):
    """Split the members of large buckets over the bits that they do not share, into max_distance + 1 exact parts."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, v, used = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
            for own in np.unique(used):
                at = used == own
                free = [x for x in range(BITS) if not (int(own) >> (BITS - 1 - x)) & 1]
                for i in range(max_distance + 1):
                    bits = free[i :: max_distance + 1]
                    k = mix(mix(key[at], i + 1), gather(v[at], bits))
                    mask = int(own) | sum(1 << (BITS - 1 - x) for x in bits)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v[at].view(np.int64)), pa.array(np.full(int(at.sum()), mask, np.uint64).view(np.int64))], names=["key", "fp", "used"])

    return keys


def forest(v: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, int]]:
    """Spanning forest of one bucket: (members, root) for each component of two or more; every member is scanned once."""
    left, out = np.arange(len(v)), []
    while len(left):
        root, left = left[0], left[1:]
        todo, own = [root], [root]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count(v[left] ^ v[x]) <= max_distance
            if hit.any():
                found = left[hit]
                todo.extend(found.tolist())
                own.extend(found.tolist())
                left = left[~hit]
        if len(own) > 1:
            out.append((np.array(own[1:]), int(root)))
    return out


def verified(max_distance: int, small: int = 96):
    """Links within buckets; the rows come sorted by key."""

    def check(key: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((cut, [len(key)])))
        group = np.repeat(np.arange(len(cut)), size)
        left_in = np.repeat(cut + size, size) - np.arange(len(key))  # members from here to the end of the bucket
        few = (size <= small)[group]
        a, b = [], []
        at, d = np.flatnonzero(few & (left_in > 1)), 1
        while len(at):
            hit = at[np.bitwise_count(v[at] ^ v[at + d]) <= max_distance]
            a.append(hit)
            b.append(hit + d)
            d += 1
            at = at[left_in[at] > d]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        links = np.bincount(group[a], minlength=len(cut)) if len(a) else np.zeros(len(cut), np.int64)
        dense = (size > small) | (links >= size)
        keep = ~dense[group[a]] if len(a) else np.zeros(0, bool)
        left, right = [v[a[keep]]], [v[b[keep]]]
        for g in np.flatnonzero(dense):
            own = v[cut[g] : cut[g] + size[g]]
            for members, root in forest(own, max_distance):
                left.append(own[members])
                right.append(np.full(len(members), own[root]))
        return np.concatenate(left), np.concatenate(right)

    def batch(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            key = np.concatenate((held_k, b.column(0).to_numpy()))
            v = np.concatenate((held_v, b.column(1).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            held_k, held_v = key[whole:], v[whole:]
            if whole:
                yield batch(*check(key[:whole], v[:whole]))
        if len(held_k):
            yield batch(*check(held_k, held_v))

    return run


def links(prints: DataFrame, column: str = "fp", max_distance: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``max_distance`` bits of each other.

    ``prints`` holds distinct fingerprints. The result is a set of spanning forests: it has the same components as all
    links together. ``bucket_rows`` bounds the memory of a bucket; larger buckets are split exactly.
    """
    spark = prints.sparkSession
    empty = spark.createDataFrame([], "a long, b long")
    parts = plan(prints, column, max_distance)
    if not parts:
        return empty
    shape, out = "key long, fp long, used long", []
    rows, tables = prints.select(column).mapInArrow(first_keys(parts), shape), []
    while True:
        rows = written(rows, "buckets")
        tables.append(rows)
        crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key")
        crowded = written(crowded, "crowded")
        any_left = not crowded.isEmpty()
        fit = rows.join(crowded, "key", "left_anti") if any_left else rows
        out.append(written(fit.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(verified(max_distance), "a long, b long").distinct(), "pairs"))
        if not any_left:
            break
        rows = rows.join(crowded, "key", "left_semi").select("key", "fp", "used").mapInArrow(child_keys(max_distance), shape)
    for t in tables:
        discard(t)
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def components(prints: DataFrame, fp: str, doc_id: str, max_distance: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """One row per distinct fingerprint: ``fp``, ``component_id`` (the smallest id reachable), ``label``.

    ``prints`` has a row per document and should be a written table, as it is read several times. Null ids count as
    larger than any; a component of null ids alone has a null component_id.
    """
    nodes = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("low")), "nodes")
    labels = connected_components(links(nodes, "fp", max_distance, bucket_rows))
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    labelled = written(labelled, "labelled")
    least = written(labelled.groupBy("label").agg(F.min("low").alias("component_id")), "least")
    discard(nodes)
    # both sides are tables, so that the join can split a large component
    return labelled.join(least, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Null texts count as empty (fingerprint zero, linked like any other); repeated rows give repeated results; an empty
    table gives an empty table; other columns are not read.
    """
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text, shingle).alias("fp")), "prints")
    found = components(prints, "fp", "doc_id", max_distance)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """Keep one document of each group: that of the smallest id (nulls last), then of the smallest row key.

    Of rows equal in every column one is kept. Columns are as in ``docs``.
    """
    r1, r2, fp = fresh(docs, "row_key", "row_key", "fp")
    keyed = docs.withColumns(dict(zip((r1, r2), row_keys(docs), strict=True)))
    prints = written(keyed.select(F.col(r1).alias("r1"), F.col(r2).alias("r2"), F.col(doc_id).alias("doc_id"), fingerprint(text, shingle).alias("fp")), "prints")
    found = written(components(prints, "fp", "doc_id", max_distance).select("fp", "label"), "found")
    return kept_firsts(keyed, prints.join(found, "fp"), (r1, r2)).select(*[f"`{c}`" for c in docs.columns])


def kept_firsts(keyed: DataFrame, labelled: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """The rows of ``keyed`` that are the first of their group: smallest id (nulls last), then smallest row key; of rows
    with one key, which are equal in every column, one.

    ``labelled``: r1, r2 (the row key, under the names ``keys`` in ``keyed``), doc_id, label. What goes is joined out, so
    ``keyed`` is shuffled only if that is much.
    """
    labelled = written(labelled.select("r1", "r2", "doc_id", "label"), "labelled")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "r1", "r2")
    # of groups of several rows; written, so that a large group can be split in the join
    first = written(labelled.groupBy("label").agg(F.min(order).alias("w"), F.count("*").alias("c")).where("c > 1").select("label", "w"), "firsts")
    named = [F.col(r).alias(k) for r, k in zip(("r1", "r2"), keys, strict=True)]
    rest = labelled.join(first, "label").where((F.col("r1") != F.col("w.r1")) | (F.col("r2") != F.col("w.r2"))).select(*named).distinct()
    rest = written(rest, "losers")
    repeated = written(labelled.groupBy(*named).count().where("count > 1").select(*keys), "repeated")
    kept = chosen(keyed, rest, list(keys), "left_anti")
    if not repeated.isEmpty():
        once = chosen(kept, repeated, list(keys), "left_semi").dropDuplicates(list(keys))
        kept = chosen(kept, repeated, list(keys), "left_anti").unionByName(once)
    discard(labelled)
    discard(first)
    return kept
