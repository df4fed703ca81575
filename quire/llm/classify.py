"""A quality classifier by co-training of two views.

One classifier sees the text (its words, by hashed frequency, and what it is made of), the other what is known about the
page without reading it (language, source, length). In each of some rounds both score every unlabelled page of the
corpus; of the pages of which one is sure, an even sample by hash goes to the other with that label. Both are then
calibrated on labelled pages that neither was fitted to, combined, and score every page.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import discard, fresh, slices, text_of, written
from .features import RATIOS, describe, labelled

#: Labelled pages that are fitted at most, and pages with pseudo-labels that a view gives the other in a round. Both are
#: drawn from all pages: the pool that is scored has no bound.
FIT_ROWS, GIFT_ROWS = 20_000, 1_000
META = ("lang", "source", "n_chars")
#: Buckets of hashed words.
WORDS = 64
_CONTENT = len(RATIOS) + 1 + WORDS


def content_values(texts: pa.Array) -> np.ndarray:
    """Ratios, log of the number of words, and the root of each word bucket's share of the words."""
    got = describe(texts, WORDS)
    return np.column_stack([*(got[c].astype(float) for c in RATIOS), np.log1p(got["n_words"]), np.sqrt(got["word_shares"])])


def meta_values(lang: list, source: list, n_chars: np.ndarray, buckets: int = 64) -> np.ndarray:
    """Bucket of the language, bucket of the source (0: null), and log length (-1: null)."""
    known: dict[str | None, int] = {None: 0}

    def bucket(s: str | None) -> int:
        if s not in known:
            known[s] = 1 + zlib.crc32(s.encode()) % (buckets - 1)
        return known[s]

    length = np.where(np.isnan(n_chars) | (n_chars < 0), -1.0, np.log1p(np.maximum(np.nan_to_num(n_chars), 0)))
    return np.column_stack([[bucket(s) for s in lang], [bucket(s) for s in source], length]).astype(float).reshape(len(lang), 3)


@dataclass
class Binned:
    """Logistic regression over one-hot quantile bins of each column and, as they are, the columns from ``linear`` on:
    additive, interpretable, and for the bins indifferent to scale."""

    edges: list[np.ndarray]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None

    @classmethod
    def over(cls, x: np.ndarray, bins: int, whole: tuple[int, ...] = (), linear: int | None = None) -> Binned:
        """``whole``: columns that hold bucket numbers below 64, each a bin of its own."""
        cut = lambda v: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.zeros(0)
        binned = x.shape[1] if linear is None else linear
        rest = x[:, binned:]
        return cls([np.arange(64) + 0.5 if j in whole else cut(x[:, j]) for j in range(binned)], rest.mean(axis=0), rest.std(axis=0) + 1e-6)

    def hot(self, x: np.ndarray) -> np.ndarray:
        out, at = np.empty((len(x), len(self.edges)), np.int64), 0
        for j, e in enumerate(self.edges):
            out[:, j] = at + np.searchsorted(e, x[:, j], side="left")
            at += len(e) + 1
        return out

    def plain(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x[:, len(self.edges) :] - self.centre) / self.scale, -6, 6)

    @property
    def width(self) -> int:
        return sum(len(e) + 1 for e in self.edges)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 12) -> Binned:
        """Newton's method with a ridge penalty; the last weight is the intercept."""
        design = np.zeros((len(x), self.width + len(self.centre) + 1))
        design[np.arange(len(x))[:, None], self.hot(x)] = 1
        design[:, self.width : -1] = self.plain(x)
        design[:, -1] = 1
        self.weights = logistic(design, y, ridge, steps)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.hot(x)].sum(axis=1) + self.plain(x) @ self.weights[self.width : -1] + self.weights[-1]


def logistic(design: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    w = np.zeros(design.shape[1])
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(h, design.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class CoTrained:
    content: Binned | None
    meta: Binned | None
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    mixture: tuple[float, float, float] = (1.0, 0.0, 0.0)
    prior: float = 1.0
    exchanged: int = 0

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability that a page is good by content, by metadata, and by both."""
        if self.content is None:
            flat = np.full(len(content), self.prior)
            return flat, flat, flat
        views = [a * m.logit(x) + b for m, x, (a, b) in zip((self.content, self.meta), (content, meta), self.calibration, strict=True)]
        both = self.mixture[0] * views[0] + self.mixture[1] * views[1] + self.mixture[2]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*views, both))


def sure_pages(views: list[Binned], content: np.ndarray, meta: np.ndarray, mark: np.ndarray, most: tuple[int, int], confident: float) -> list[tuple[int, int, int]]:
    """Pages of which a view is sure: (view, label, row), for each view and label the ``most[label]`` of the least mark.

    The choice over parts of a pool, made again over what the parts chose, is the choice over the whole.
    """
    out = []
    for v, x in enumerate((content, meta)):
        z = views[v].logit(x)
        bar = np.log(confident / (1 - confident))
        for label, sure in ((0, z <= -bar), (1, z >= bar)):
            rows = np.flatnonzero(sure)
            out += [(v, label, int(i)) for i in rows[np.argsort(mark[rows], kind="stable")][: most[label]]]
    return out


def co_train(content: np.ndarray, meta: np.ndarray, label: np.ndarray, draw=None, rounds: int = 4, confident: float = 0.95, gifts: int = GIFT_ROWS, linear: int | None = None) -> CoTrained:
    """Fit both views. ``label`` is 1, 0 or -1 (unlabelled). Every fourth labelled row is kept for calibration.

    In each round a view gives the other up to ``gifts`` pages, in the proportion of the classes among the labelled pages,
    of those whose probability of their class is at least ``confident``. ``draw(views, turn, most, confident)`` chooses
    them from a pool elsewhere and gives (view, label, content, meta) rows; without it the rows of label -1 are the pool.
    Without both classes the model is the share of good pages (1 without any label). ``linear``: first content column
    that is not binned.
    """
    known = np.flatnonzero(label >= 0)
    held = known[np.arange(len(known)) % 4 == 3]
    train = np.setdiff1d(known, held)
    if any(len(np.unique(label[s])) < 2 for s in (train, held)):
        return CoTrained(None, None, prior=float(label[known].mean()) if len(known) else 1.0)
    if draw is None:
        draw = local_pool(content[label < 0], meta[label < 0])
    data = [content, meta]
    views = [Binned.over(content[known], 16, (), linear), Binned.over(meta[known], 16, (0, 1))]
    rows, marks = [x[train] for x in data], [label[train].astype(float)] * 2
    good, given = label[train].mean(), 0
    most = (max(1, round(gifts * (1 - good))), max(1, round(gifts * good)))
    for turn in range(rounds + 1):
        for v in (0, 1):
            views[v].fit(rows[v], marks[v])
        if turn == rounds:
            break
        for v, mark, *own in draw(views, turn, most, confident):
            given += 1
            rows[1 - v] = np.vstack((rows[1 - v], own[1 - v]))
            marks[1 - v] = np.append(marks[1 - v], mark)
    y = label[held].astype(float)
    raw = [views[v].logit(data[v][held]) for v in (0, 1)]
    plain = [logistic(np.column_stack((r, np.ones(len(r)))), y, 1e-2, 25) for r in raw]
    shown = [a * r + b for r, (a, b) in zip(raw, plain, strict=True)]
    mixed = logistic(np.column_stack((*shown, np.ones(len(y)))), y, 1e-1, 25)
    return CoTrained(views[0], views[1], tuple((float(a), float(b)) for a, b in plain), tuple(map(float, mixed)), exchanged=given)


def marks_of(content: np.ndarray, meta: np.ndarray, turn: int) -> np.ndarray:
    """An even mark of each page, by the bytes of its features, another in every round; equal pages share it."""
    wide = np.ascontiguousarray(np.column_stack((content, meta)), np.float32)
    return np.fromiter((xxhash.xxh3_64_intdigest(r.tobytes(), turn) for r in wide), np.uint64, len(wide))


def local_pool(content: np.ndarray, meta: np.ndarray):
    """``draw`` over arrays; a page is given to a view once."""
    given: list[set[int]] = [set(), set()]

    def draw(views, turn, most, confident):
        mark, first = marks_of(content, meta, turn), marks_of(content, meta, -1)
        out = []
        for v in (0, 1):
            free = np.flatnonzero(~np.isin(first, np.array(sorted(given[v]), np.uint64)))
            free = free[np.sort(np.unique(first[free], return_index=True)[1])]
            for w, label, i in sure_pages(views, content[free], meta[free], mark[free], most, confident):
                if w == v:
                    out.append((v, label, content[free[i]], meta[free[i]]))
        for v, _, c, m in out:
            given[v].add(int(marks_of(c[None], m[None], -1)[0]))
        return out

    return draw


def _meta_columns(docs: DataFrame) -> list:
    have = set(docs.columns)
    return [F.col(c).cast("double" if c == "n_chars" else "string").alias(c) if c in have else F.lit(None).cast("double" if c == "n_chars" else "string").alias(c) for c in META]


def _values(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    at = 0
    for part in slices(b.column("text"), 4 << 20):
        rows = b.slice(at, len(part))
        at += len(part)
        meta = meta_values(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), rows.column("n_chars").to_numpy(zero_copy_only=False).astype(float))
        yield rows, np.column_stack((content_values(part), meta)).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), _CONTENT + len(META)).astype(float)


def spark_pool(pool: DataFrame):
    """``draw`` over a table with a column ``x``: every task scores its pages and keeps what it may give."""
    given: list[set[int]] = [set(), set()]
    shape = "view int, label int, mark long, x array<float>"

    def draw(views, turn, most, confident):
        taken = [np.array(sorted(g), np.uint64) for g in given]

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], dict[int, np.ndarray]] = {(v, k): {} for v in (0, 1) for k in (0, 1)}
            for b in batches:
                x = _matrix(b.column("x"))
                for at in range(0, len(x), 8192):
                    part = x[at : at + 8192]
                    content, meta = part[:, :_CONTENT], part[:, _CONTENT:]
                    mark, first = marks_of(content, meta, turn), marks_of(content, meta, -1)
                    for v in (0, 1):
                        free = np.flatnonzero(~np.isin(first, taken[v]))
                        free = free[np.sort(np.unique(first[free], return_index=True)[1])]
                        for w, label, i in sure_pages(views, content[free], meta[free], mark[free], most, confident):
                            if w == v:
                                best[v, label][int(mark[free[i]])] = part[free[i]]
                        for label in (0, 1):
                            own = best[v, label]
                            for m in sorted(own)[most[label] :]:
                                del own[m]
            rows = [(v, k, m, x) for (v, k), own in best.items() for m, x in own.items()]
            if rows:
                marks = np.array([r[2] for r in rows], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array((marks ^ np.uint64(1 << 63)).view(np.int64)), pa.array([r[3].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                    names=["view", "label", "mark", "x"],
                )

        chosen = written(pool.select("x").mapInArrow(choose, shape), "sure")
        out = []
        for v in (0, 1):
            for label in (0, 1):
                for r in chosen.where((F.col("view") == v) & (F.col("label") == label)).dropDuplicates(["mark"]).orderBy("mark").limit(most[label]).collect():
                    x = np.array(r["x"], np.float32).astype(float)
                    out.append((v, label, x[:_CONTENT], x[_CONTENT:]))
        discard(chosen)
        for v, _, c, m in out:
            given[v].add(int(marks_of(c[None], m[None], -1)[0]))
        return out

    return draw


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS, gifts: int = GIFT_ROWS) -> CoTrained:
    """Co-train on at most ``rows`` labelled pages, those of the smallest id hash, and on what both views give each other
    of all pages without a label. The features of all pages are written once; only chosen rows come to the driver."""

    def describe_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _values(b):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])

    pages = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"), *_meta_columns(docs))
    all_ = written(pages.mapInArrow(describe_all, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, x array<float>"), "features")
    own = labelled(labels, rows, doc_id=doc_id)
    frame = all_.join(F.broadcast(own), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(frame["x"].tolist(), float).reshape(-1, _CONTENT + len(META))
    pool = written(all_.join(labels.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_anti").select("x"), "pool")
    model = co_train(x[:, :_CONTENT], x[:, _CONTENT:], frame["label"].to_numpy(np.int64), spark_pool(pool), gifts=gifts, linear=_CONTENT - WORDS)
    discard(all_)
    discard(pool)
    return model


SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("content", "meta", "quality")])


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS, gifts: int = GIFT_ROWS) -> DataFrame:
    """All columns of ``docs`` and a struct ``scores`` (another name if taken): content, meta, quality, from 0 to 1.

    Every page is scored over its whole text. Null texts count as empty; null or missing metadata have a value of their
    own; equal rows get equal scores; an empty table gives an empty table, and no labels give 1 everywhere.
    """
    model = fit(docs, labels, text, doc_id, rows, gifts)

    @arrow_udf(SCORES)
    def co_trained(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, lang, source, n_chars in batches:
            out, at = [], 0
            for part in slices(texts, 4 << 20):
                cut = slice(at, at + len(part))
                meta = meta_values(lang[cut].to_pylist(), source[cut].to_pylist(), n_chars[cut].to_numpy(zero_copy_only=False).astype(float))
                out.append(np.column_stack(model.scores(content_values(part), meta)))
                at += len(part)
            values = np.concatenate(out) if out else np.zeros((0, 3))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, j])) for j in range(3)], ["content", "meta", "quality"])

    (name,) = fresh(docs, "scores")
    return docs.withColumn(name, co_trained(text_of(text), *_meta_columns(docs)))
