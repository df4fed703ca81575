"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, exact sets verify them.

* Texts of equal shingle sets are one node throughout.
* Fingerprints within four bits of each other (:mod:`.simhash`, by the general pigeonhole principle) are candidates; they
  are the closest copies. A pair of similarity 0.8 differs in about ten of 64 bits, which no probing of fingerprints
  finds at a bearable cost, so a pair is a candidate too if it shares a band of MinHash values: 20 bands of 4 miss a pair
  of similarity 0.8 with a chance of ``(1 - 0.8**4)**20``, 3 in 100,000, and a closer pair more rarely.
* Candidates are joined to groups, and each group of bounded size is verified on the exact sets in one task, to which
  every set travels once. Verification follows a spanning forest and emits links, not pairs.
* A group beyond the bound is verified bucket by bucket. In a bucket beyond the bound, the members first meet a few
  pivots, which joins a large group of copies at a cost of its own size; what is still apart then meets in pairs of
  blocks. This is exact: no candidate is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import simhash
from .common import batch_bytes, chosen, discard, fresh, row_keys, text_of, written
from .graph import connected_components

BANDS, ROWS = 20, 4
_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Shingles hashed at once, and shared shingles counted at once, to bound working memory.
_CHUNK, _COUNTED = 1 << 14, 1 << 22
#: Sets and shingles that one task verifies together.
GROUP_SETS, GROUP_SHINGLES = 4096, 4 << 20


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64 values of the shingles; words and case as in ``simhash.fingerprint_bytes``."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band: the mix of its minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), _CHUNK):
            part = own[at : at + _CHUNK]
            for k in range(BANDS * ROWS):
                x = part * _MUL[k] + _ADD[k]
                low[k] = min(low[k], (x ^ (x >> np.uint64(32))).min())
    low = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = simhash.mix(key, low[:, r])
    return key


SKETCH = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _sketcher(shingle: int):
    from .telephony import to_arrow

    @arrow_udf(SKETCH)
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow(SKETCH)
        for texts in batches:
            out = []
            for t in batch_bytes(texts):
                own = shingle_set(t, shingle)
                fp = np.array([simhash.majority(own)], np.uint64).view(np.int64)[0]
                out.append({"node": xxhash.xxh3_128_digest(own.tobytes()), "n": len(own), "fp": int(fp), "bands": band_keys(own).view(np.int64).tolist() if len(own) else []})
            yield pa.array(out, kind)

    return sketch


def _setter(shingle: int):
    @arrow_udf(T.ArrayType(T.LongType()))
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingle_set(t, shingle).view(np.int64) for t in batch_bytes(texts)], pa.list_(pa.int64()))

    return whole


# --- verifying ---------------------------------------------------------------------------------------------------


def linked(own: list[np.ndarray], label: np.ndarray, hundredths: int) -> list[tuple[int, int]]:
    """Links that make the components of a group of sets; sets of equal label are connected already.

    Each set is compared once with all sets that are not yet connected to it, by counting how often each of them occurs
    among the holders of its shingles.
    """
    n = np.fromiter(map(len, own), np.int64, len(own))
    if len(own) == 2:
        both = len(np.intersect1d(own[0], own[1], assume_unique=True)) if label[0] != label[1] and 100 * n.min() >= hundredths * n.max() else 0
        return [(0, 1)] if both and 100 * both >= hundredths * (n.sum() - both) else []
    flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    _, shingle, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[shingle] > 1
    holder, shingle = owner[shared], shingle[shared]  # holders by shingle
    first = np.cumsum(times * (times > 1)) - times
    by_set = np.argsort(holder, kind="stable")
    of_set, ends = shingle[by_set], np.cumsum(np.bincount(holder, minlength=len(own)))

    def common(x: int) -> np.ndarray:
        mine, out = of_set[(ends[x - 1] if x else 0) : ends[x]], np.zeros(len(own), np.int64)
        rows = np.cumsum(times[mine])
        at = 0
        while at < len(mine):
            stop = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + _COUNTED, side="right")))
            part = mine[at:stop]
            size = times[part]
            where = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out += np.bincount(holder[where], minlength=len(own))
            at = stop
        return out

    left, out = np.arange(len(own)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            both, same = common(x)[left], label[left] == label[x]
            hit = (both > 0) & (100 * both >= hundredths * (n[left] + n[x] - both))
            out += [(x, int(y)) for y in left[hit & ~same]]
            todo += left[hit | same].tolist()
            left = left[~(hit | same)]
    return out


def _verifier(hundredths: int):
    """Links of every group; the rows (g, node, label, own) come sorted by g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            node = rows.column("node").combine_chunks()
            own = [x.values.to_numpy(zero_copy_only=False) for x in rows.column("own").combine_chunks()]
            label = np.unique(np.array([str(x) for x in rows.column("label").to_pylist()]), return_inverse=True)[1]
            if pairs := linked(own, label, hundredths):
                a, b = (node.take(pa.array([p[k] for p in pairs])) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for b in batches:
            g = b.column("g").to_numpy()
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if hi > lo:
                    if held and held[-1].column("g")[0].as_py() != int(g[lo]):
                        yield from settle()
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from settle()

    return run


def verified(groups: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """Links (a, b) within groups (g, node, label) of bounded size."""
    kind = sets.schema["node"].dataType.simpleString()
    rows = groups.select("g", "node", "label").join(sets.select("node", "own"), "node").select("g", "node", "label", "own")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_verifier(hundredths), f"a {kind}, b {kind}")


def _similar(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """The pairs whose sets have the similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("own_a", "own_b"))
    all_ = F.size("own_a") + F.size("own_b") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= hundredths * all_).select("a", "b")


def links(buckets: DataFrame, sets: DataFrame, hundredths: int, rounds: int = 2, most_sets: int = GROUP_SETS, most_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Verified links (a, b) that connect what the pairs of each bucket connect. ``buckets``: key, node, n.

    Buckets beyond the bounds meet ``rounds`` pivots first. What is still apart meets in pairs of blocks.
    """
    kind = sets.schema["node"].dataType.simpleString()
    blocks = F.ceil(F.greatest(F.count("*") * (2.0 / most_sets), F.sum("n") * (2.0 / most_shingles))).cast("int")
    crowd = lambda x: x.groupBy("key").agg(blocks.alias("blocks"), (F.min("label") != F.max("label")).alias("apart"))
    state = written(buckets.select("key", "node", "n", F.col("node").alias("label")), "members")
    found = None
    for turn in range(rounds):
        crowded = state.join(crowd(state).where("blocks > 2 and apart").select("key"), "key", "left_semi")
        pivot = crowded.groupBy("key").agg(F.max_by(F.struct("node", "n", "label"), F.xxhash64("node", F.lit(turn))).alias("p"))
        fits = (100 * F.least("n", "p.n") >= hundredths * F.greatest("n", "p.n")) & (F.col("label") != F.col("p.label"))
        pairs = crowded.join(pivot, "key").where(fits).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        new = written(_similar(pairs, sets, hundredths), "similar")
        if new.isEmpty():
            discard(new)
            break
        found = new if found is None else found.unionByName(new)
        labels = written(connected_components(found), "labels")
        then = state.select("key", "node", "n").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
        before, state = state, written(then, "members")
        discard(before)
        discard(labels)
    # a member of block i meets blocks 0, 1, ... in the tasks (i, j); a bucket of one or two blocks is one task
    own = F.when(F.col("blocks") > 2, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.lit(0)).cast("int")
    others = F.when(F.col("blocks") > 2, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    dealt = state.join(crowd(state).where("apart"), "key").withColumn("i", own).withColumn("j", F.explode(others))
    groups = dealt.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "node", "label")
    last = written(verified(groups, sets, hundredths), "similar")
    discard(state)
    assert last.schema["a"].dataType.simpleString() == kind
    return last if found is None else found.unionByName(last)


def same_members_once(members: DataFrame) -> DataFrame:
    """Of buckets (key, node, n) with the same members one is kept."""
    print_ = members.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return members.join(print_.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def candidates(prints: DataFrame, max_distance: int = 4) -> DataFrame:
    """Buckets of two nodes or more: key, node, n, hub (the least node of the bucket). ``prints``: node, n, fp, bands."""
    # copies of a text repeat its node; the least and greatest node tell whether a bucket holds different ones
    banded = prints.select("node", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    by_bands = banded.join(shared, "key").distinct()
    filled = prints.where("n > 0").select("fp", "node", "n").distinct()
    near = connected_components(simhash.links(written(filled.select("fp").distinct(), "fingerprints"), "fp", max_distance))
    groups = filled.join(near, filled["fp"] == near["node"], "left").select(filled["node"], "n", F.xxhash64(F.lit("simhash"), F.coalesce("label", "fp")).alias("key"))
    kept = groups.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    columns = ("key", "node", "n", "hub")
    return by_bands.select(*columns).unionByName(groups.join(kept, "key").select(*columns))


def components(prints: DataFrame, sets_of, hundredths: int = 80, most_sets: int = GROUP_SETS, most_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Labels (node, label) of nodes that verified links connect; nodes without a link may be left out.

    ``sets_of(nodes)`` gives the table (node, own) of the shingle sets of some nodes.
    """
    members = written(candidates(prints), "members")
    labels = connected_components(members.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    nodes = written(members.select("node", "n").distinct().join(labels, "node"), "candidates")
    sets = written(sets_of(nodes.select("node")), "sets")
    size = nodes.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    size = size.withColumn("fits", (F.col("c") <= most_sets) & (F.col("s") <= most_shingles))
    sized = written(nodes.join(size.select("label", "fits"), "label"), "groups")
    whole = sized.where("fits").select(F.xxhash64("label").alias("g"), "node", F.col("node").alias("label"))
    found = written(verified(whole, sets, hundredths), "similar")
    large = sized.where("not fits").select("node")
    tables = [members, nodes, sets, sized]
    if not large.isEmpty():
        wide = same_members_once(members.join(large, "node", "left_semi").select("key", "node", "n"))
        found = found.unionByName(links(wide, sets, hundredths, most_sets=most_sets, most_shingles=most_shingles))
    out = written(connected_components(found), "labels")
    for t in tables:
        discard(t)
    return out


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, hundredths: int = 80) -> DataFrame:
    """Keep one document of each group of near copies: that of the smallest id (nulls last), then of the smallest row key.

    Two texts are linked if the Jaccard similarity of their shingle sets is ``hundredths`` or more. Null texts count as
    empty, and empty texts are copies of each other. Of rows equal in every column one is kept (nulls equal nulls only).
    Very long texts are hashed in chunks. An empty table gives an empty table. Columns are as in ``docs``, whatever
    their names.
    """
    r1, r2, sketch = fresh(docs, "row_key", "row_key", "sketch")
    keyed = docs.withColumns(dict(zip((r1, r2), row_keys(docs), strict=True)))
    prints = keyed.select(F.col(r1).alias("r1"), F.col(r2).alias("r2"), F.col(doc_id).alias("doc_id"), _sketcher(shingle)(text_of(text)).alias(sketch))
    prints = written(prints.select("r1", "r2", "doc_id", f"{sketch}.*"), "sketches")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # one row stands for the copies of a text
        least = prints.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("r"))
        need = written(least.select(F.col("r.r1").alias(r1), F.col("r.r2").alias(r2), "node"), "needed")
        texts = chosen(keyed.select(r1, r2, text_of(text).alias("t")), need, [r1, r2], "inner")
        own = texts.select("node", _setter(shingle)(F.col("t")).alias("own"))
        return own if none_repeated else own.dropDuplicates(["node"])

    repeated = written(prints.groupBy(F.col("r1").alias(r1), F.col("r2").alias(r2)).count().where("count > 1").select(r1, r2), "repeated")
    none_repeated = repeated.isEmpty()
    labels = components(prints, sets_of, hundredths)
    labelled = prints.select("r1", "r2", "doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = simhash.kept_firsts(keyed, labelled, (r1, r2))
    for t in (prints, labels, repeated):
        discard(t)
    return kept.select(*[f"`{c}`" for c in docs.columns])
