"""Stupid-backoff scores of every document under n-gram counts of the whole corpus.

Equal texts are scored once and count as often as they occur. Distinct texts are dealt into blocks. A block sends each of
its distinct n-grams once, with its count in the block, to the partition of the count table that the n-gram's hash
names; there the counts are added up and joined back to the n-grams that the blocks asked for, and the block sums the
scores per document. So the most frequent n-gram makes one entry per block, however many documents hold it.

A block sends ``FAN`` rows per order at most. Where the count table has more partitions, the rows of ``FAN`` blocks that
name the same group of partitions meet first, are added up, and are sent on as one block is, level by level; answers
come back the same way. So rows grow in proportion to the corpus, at every size.

N-grams are packed as hashes, not as rows: a row per n-gram takes 26 bytes of shuffle where 8 do. An n-gram is known by a
64-bit hash within the partition that a second, independent hash names. Partitions grow in number with the corpus, so the
chance that two n-grams are taken for one does not grow with the square of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, flat_words, fresh, text_of

#: Scores are summed in millionths, as integers, so that sums do not depend on the order of addition.
MICRO = 1_000_000
_GOLD, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MUL
        x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(32))


def pack(counts: np.ndarray) -> bytes:
    """Counts as one byte each, 255 standing for those in the 8-byte integers that follow, in order."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", offset=n)
    return counts


class Grams:
    """The n-grams of a block of texts: for each order, the entry of each word in the distinct (partition, hash) pairs."""

    def __init__(self, texts: pa.Array, order: int, partitions: int):
        flat, self.sizes = flat_words(texts, lower=True)
        coded = flat.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        codes = np.asarray(coded.indices)
        grown = [np.zeros(0, np.uint64)] * 2
        known = [np.fromiter(map(digest, words), np.uint64, len(words)) for digest in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest)]
        word = [k[codes] if len(words) else np.zeros(0, np.uint64) for k in known]
        self.n = len(codes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(self.n) - np.repeat(starts, self.sizes)
        self.at: list[np.ndarray] = []  # for each order, the positions of the last words
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []  # distinct (partition, hash), in order
        self.entry: list[np.ndarray] = []  # for each position, its entry in keys
        for k in range(order):
            with np.errstate(over="ignore"):
                grown = [_scramble(w * _GOLD) if k == 0 else _scramble(np.concatenate((g[:1], g[:-1])) * np.uint64(3) + w + _GOLD * np.uint64(k)) for g, w in zip(grown, word, strict=True)]
            at = np.flatnonzero(self.place >= k)
            h, part = grown[0][at], (grown[1][at] % np.uint64(partitions)).astype(np.int64)
            by = np.argsort(h)
            by = by[np.argsort(part[by], kind="stable")]
            sh, sp = h[by], part[by]
            new = np.ones(len(sh), bool)
            new[1:] = (sh[1:] != sh[:-1]) | (sp[1:] != sp[:-1])
            entry = np.empty(len(sh), np.int64)
            entry[by] = np.cumsum(new) - 1
            self.at.append(at)
            self.keys.append((sp[new], sh[new]))
            self.entry.append(entry)

    def times(self, k: int, copies: np.ndarray) -> np.ndarray:
        """Occurrences of each entry of an order, where each text counts ``copies`` times."""
        weight = np.repeat(copies, self.sizes)[self.at[k]]
        return np.bincount(self.entry[k], weights=weight, minlength=len(self.keys[k][0])).astype(np.int64)


def _column(table: pa.Table, name: str) -> pa.Array:
    x = table.column(name).combine_chunks()
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


#: Rows that a block sends for an order at most, and blocks that are added up on the way to more partitions.
FAN = 1024
ASKED = "bucket long, `order` int, `from` long, place long, parts binary, hashes binary, times binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("order", pa.int32()), ("from", pa.int64()), ("place", pa.int64()), ("parts", pa.binary()), ("hashes", pa.binary()), ("times", pa.binary())])
ANSWERED = "to long, bucket long, `order` int, counts binary"
_ANSWERED = pa.schema([("to", pa.int64()), ("bucket", pa.int64()), ("order", pa.int32()), ("counts", pa.binary())])


def _send(part: np.ndarray, h: np.ndarray, times: np.ndarray, per: int, order: int, own: int, place: int, out: dict[str, list]) -> None:
    """Rows of one sender: its entries (sorted by partition, then hash) by bucket of ``per`` partitions.

    ``own`` names the sender, ``place`` its place among those that send to the same buckets.
    """
    bucket = part // per
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(cut, [*cut[1:], len(part)], strict=False):
        inner = part[a:b] - bucket[a] * per
        for c, x in (("bucket", int(bucket[a])), ("order", order), ("from", own), ("place", place), ("parts", pack(inner) if per > 1 else b""), ("hashes", h[a:b].tobytes()), ("times", pack(times[a:b]))):
            out[c].append(x)


class _Sum:
    """The entries of several rows of one bucket added up, and where the entries of each row went."""

    def __init__(self, table: pa.Table, per: int):
        bucket = table.column("bucket")[0].as_py()
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = [len(x) for x in hashes]
        times = np.concatenate([unpack(x, n) for x, n in zip(table.column("times").to_pylist(), sizes, strict=True)])
        parts = np.concatenate([unpack(x, n) if per > 1 else np.zeros(n, np.int64) for x, n in zip(table.column("parts").to_pylist(), sizes, strict=True)]) + bucket * per
        h = np.concatenate(hashes)
        by = np.argsort(h)
        by = by[np.argsort(parts[by], kind="stable")] if per > 1 else by
        sh, sp = h[by], parts[by]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (sp[1:] != sp[:-1])
        self.where = np.empty(len(sh), np.int64)
        self.where[by] = np.cumsum(new) - 1
        self.part, self.hash = sp[new], sh[new]
        self.times = np.bincount(self.where, weights=times, minlength=len(self.hash)).astype(np.int64)
        self.ends = np.cumsum([0, *sizes])

    def back(self, table: pa.Table, counts: np.ndarray, to: str) -> pa.Table:
        mine = counts[self.where]
        packed = [pack(mine[a:b]) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]
        return pa.table({"to": table.column(to), "bucket": table.column("bucket"), "order": table.column("order"), "counts": packed}, schema=_ANSWERED)


def _received(answers: pa.Table, order: int, buckets: np.ndarray) -> np.ndarray:
    """Counts of a sender's entries of an order, in its own sequence. ``buckets``: that of each entry."""
    own = answers.filter(pc.equal(answers.column("order"), order)).sort_by("bucket")
    sizes = np.unique(buckets, return_counts=True)[1].tolist()
    got = [unpack(c, n) for c, n in zip(own.column("counts").to_pylist(), sizes, strict=True)]
    return np.concatenate(got) if got else np.zeros(0, np.int64)


def counted(asked: DataFrame, per: int, fan: int, senders: int, orders: int) -> DataFrame:
    """Answers to questions by buckets of ``per`` partitions: the corpus count of every entry, for every sender.

    ``senders``: places of senders below which all lie.
    """
    if per == 1:

        def count(table: pa.Table) -> pa.Table:
            total = _Sum(table, 1)
            return total.back(table, total.times, "from")

        return asked.groupBy("bucket", "order").applyInArrow(count, ANSWERED)
    below = max(1, per // fan)

    def relay(table: pa.Table) -> pa.Table:
        total, out = _Sum(table, per), {c: [] for c in _ASKED.names}
        _send(total.part, total.hash, total.times, below, table.column("order")[0].as_py(), table.column("relay")[0].as_py(), table.column("place")[0].as_py() // fan, out)
        return pa.table(out, schema=_ASKED)

    def give(table: pa.Table, answers: pa.Table) -> pa.Table:
        total = _Sum(table, per)
        return total.back(table, _received(answers, table.column("order")[0].as_py(), total.part // below), "from")

    # a number for each bucket, order and group of senders
    groups = senders // fan + 1
    met = asked.withColumn("relay", F.expr(f"(bucket * {orders} + `order`) * {groups} + place div {fan}"))
    further = counted(met.groupBy("relay").applyInArrow(relay, ASKED), below, fan, groups, orders)
    return met.groupBy("relay").cogroup(further.groupBy("to")).applyInArrow(give, ANSWERED)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a batch once, with its number of copies."""
    for b in batches:
        keys = np.stack([b.column(k).to_numpy() for k in (0, 1)], axis=1)
        _, first, copies = np.unique(keys, axis=0, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in b.columns), pa.array(copies)], names=["t1", "t2", "text", "copies"])


def stupid_backoff(
    docs: DataFrame,
    text: str = "text",
    order: int = 2,
    alpha: float = 0.4,
    min_count: int = 2,
    block_bytes: int = 4 << 20,
    partition_bytes: int = 12 << 20,
    fan: int = FAN,
) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens``, ``n_backoff`` and ``score_micro`` (new names if these are taken).

    Words are runs of other characters than space and U+0009-U+000D, A-Z lower-cased; an n-gram lies within one
    document. ``score_micro`` is the sum over words of ``round(1e6 ln S)``, where S of a word after its context is
    ``count(context, word) / count(context)`` if the n-gram of the longest available order occurs ``min_count`` times or
    more in the corpus, else ``alpha`` times S after the context without its first word; S of a word alone is
    ``count(word) / number of words``. ``n_backoff`` counts the steps back.

    Null or empty texts and texts without words: zero tokens and score. Repeated rows are scored each, and each adds to
    the counts. An empty table gives an empty table.
    """
    t1, t2, n_tokens, n_backoff, score = fresh(docs, "text_key", "text_key", "n_tokens", "n_backoff", "score_micro")
    keys = (F.xxhash64(F.lit(1), text_of(text)), F.xxhash64(F.lit("second"), text_of(text)))
    plain = docs.select(keys[0].alias("t1"), keys[1].alias("t2"), text_of(text).alias("text"))
    size, words = plain.select(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(WORD_PATTERN)))).first()
    blocks = max(1, -(-(size or 0) // block_bytes))
    partitions = max(1, -(-(size or 0) // partition_bytes))
    total, top = words or 0, 1
    while top * fan < partitions:
        top *= fan

    def ask(table: pa.Table) -> pa.Table:
        """A block's distinct n-grams, packed by bucket and order: hashes in order, and their counts."""
        out: dict[str, list] = {c: [] for c in _ASKED.names}
        if table.num_rows:
            g, copies, own = Grams(_column(table, "text"), order, partitions), _column(table, "copies").to_numpy(), table.column("block")[0].as_py()
            for k in range(order):
                _send(*g.keys[k], g.times(k, copies), top, k, own, own, out)
        return pa.table(out, schema=_ASKED)

    def sum_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a block's texts from the counts of its n-grams."""
        g = Grams(_column(rows, "text"), order, partitions)
        got: list[np.ndarray] = []
        for k in range(order):
            full = np.zeros(g.n)
            full[g.at[k]] = _received(answers, k, g.keys[k][0] // top).astype(np.float64)[g.entry[k]]
            got.append(full)
        value, steps, open_ = np.zeros(g.n, np.int64), np.zeros(g.n, np.int64), np.ones(g.n, bool)
        longest = np.minimum(g.place, order - 1)
        for k in range(order - 1, 0, -1):
            ready = open_ & (longest >= k)
            at = np.flatnonzero(ready & (got[k] >= min_count))
            value[at] = np.rint(np.log(alpha ** steps[at] * got[k][at] / got[k - 1][at - 1]) * MICRO).astype(np.int64)
            open_[at] = False
            steps[ready & open_] += 1
        at = np.flatnonzero(open_)
        value[at] = np.rint(np.log(alpha ** steps[at] * got[0][at] / total) * MICRO).astype(np.int64)
        doc = np.repeat(np.arange(len(g.sizes)), g.sizes)
        sums, backs = np.zeros(len(g.sizes), np.int64), np.zeros(len(g.sizes), np.int64)
        np.add.at(sums, doc, value)
        np.add.at(backs, doc, steps)
        return pa.table({"t1": rows.column("t1"), "t2": rows.column("t2"), "n": pa.array(g.sizes), "back": pa.array(backs), "sum": pa.array(sums)})

    # equal texts of a batch become one row before the shuffle; both uses read the same columns, so they share one exchange
    dealt = plain.mapInArrow(_once, "t1 long, t2 long, text string, copies long").withColumn("block", F.pmod("t1", F.lit(blocks))).repartition("block")
    dealt = dealt.groupBy("block", "t1", "t2").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    answers = counted(dealt.groupBy("block").applyInArrow(ask, ASKED), top, fan, blocks, order)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(sum_up, "t1 long, t2 long, n long, back long, sum long")
    keyed = docs.withColumns({t1: keys[0], t2: keys[1]})
    named = scored.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("n").alias(n_tokens), F.col("back").alias(n_backoff), F.col("sum").alias(score))
    return keyed.join(named, [t1, t2]).select(*[f"`{c}`" for c in docs.columns], n_tokens, n_backoff, score)
