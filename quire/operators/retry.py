"""Recognition of the lines of a page with retries, by an injected scorer.

The number of extra recognitions is budgeted per page and spent in the order of detection, so a page is handled in order
by one task and pages run in parallel. The scorer never sees Spark: it gets a :class:`Attempt` and returns the fields of
a decoding, or raises, which keeps the other candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.plans.config import RETRY, Options

FILTERS = ("grayscale-contrast", "background-normalized", "ink-channel", "adaptive-binary")
Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Attempt:
    """What to recognise: a region of the page image (or of the crop service), prepared in some way."""

    page: str
    det_idx: int
    region: Box
    source: str = "page"
    preprocessing: str = "original"
    orientation: str = "auto"
    deskew_angle: float | None = None


@dataclass
class Decoded:
    text: str
    recognition_score: float
    minimum_token_score: float
    mean_token_margin: float
    ended_with_eos: bool
    eos_score: float | None = None


Scorer = Callable[[Attempt], Decoded]


@dataclass
class Budget:
    """Extra recognitions that a page may spend, and what it did."""

    most: int
    attempts: int = 0
    done: int = 0
    failed: int = 0
    rows: list = field(default_factory=list)

    def begin(self) -> bool:
        if self.attempts >= self.most:
            return False
        self.attempts += 1
        return True

    @property
    def left(self) -> int:
        return self.most - self.attempts


def is_low(d: Decoded, region: Box, profile: str) -> bool:
    """The retry rule of :func:`quire.operators.recognise.low_confidence`, for a single line."""
    _, _, w, h = region
    if not d.text.strip("﻿ \t\n\r\v\f      　" + "".join(map(chr, range(0x2000, 0x200B)))) or not d.ended_with_eos:
        return True
    if d.recognition_score < RETRY.get(profile, RETRY["balanced"]) or d.minimum_token_score < 0.28 or d.mean_token_margin < 0.35:
        return True
    return max(w, h) / max(1.0, min(w, h)) >= 8 and len(d.text.encode("utf-16-be")) // 2 < 2


def windows(region: Box, most: int, overlap: float = 0.2) -> list[Box]:
    """Windows along a long line, as :func:`quire.operators.tiles.line_windows` makes them, without clipping."""
    x, y, w, h = region
    vertical = h > w
    size, short = (h, max(1.0, w)) if vertical else (w, max(1.0, h))
    if size / short < 8:
        return [region]
    n = min(max(2, most), max(2, int(-(-size // (short * 4)))))
    length = size / (n - (n - 1) * overlap)
    starts = [min(size - length, i * length * (1 - overlap)) for i in range(n)]
    return [(x, y + s, w, length) if vertical else (x + s, y, length, h) for s in starts]


def recognise_line(page: str, det_idx: int, region: Box, padded: Box, scorer: Scorer, options: Options, budget: Budget, has_crops: bool, angle: Callable[[Attempt], float | None] | None, merge: Callable) -> list[tuple[Attempt, Decoded]]:
    """Candidates of one line in order: the original, then retries as confidence, options and budget allow."""
    out: list[tuple[Attempt, Decoded]] = []

    def attempt(keep: bool = True, **how) -> Decoded | None:
        a = Attempt(page, det_idx, how.pop("region", region), **how)
        try:
            d = scorer(a)
        except Exception:  # a failed retry keeps the candidates so far
            budget.failed += 1
            return None
        budget.done += 1
        if keep:
            out.append((a, d))
        return d

    first = scorer(Attempt(page, det_idx, region))
    out.append((Attempt(page, det_idx, region), first))
    low = is_low(first, region, options.profile)
    _, _, w, h = region
    if low and (max(w, h) / max(1.0, min(w, h)) < 1.8 or options.profile == "accurate") and budget.begin():
        attempt(orientation="normal" if h > w else "rotate-90")
    if low and budget.begin():
        second = attempt(region=padded, preprocessing="padded")
        still = lambda: second is not None and is_low(second, region, options.profile) and budget.left > 0
        if options.high_resolution_retry and still() and has_crops and budget.begin():
            attempt(source="iiif-crop", preprocessing="high-resolution-original")
        if options.deskew_retry and still():
            best = angle(Attempt(page, det_idx, padded)) if angle else None
            if best is not None and budget.begin():
                attempt(deskew_angle=best)
        if options.profile == "accurate" and still():
            for name in FILTERS:
                if not budget.begin():
                    break
                attempt(region=padded, preprocessing=name)
    if options.long_line_segmentation and (low or options.profile == "accurate") and budget.left > 0:
        parts = windows(region, min(4, budget.left))
        if 1 < len(parts) <= budget.left:
            got = []
            for part in parts:
                budget.begin()
                d = attempt(keep=False, region=part)
                if d is None:
                    break
                got.append(d)
            text = merge([d.text for d in got]) if len(got) == len(parts) else None
            if text is not None:
                n = len(got)
                joined = Decoded(text, sum(d.recognition_score for d in got) / n, min(d.minimum_token_score for d in got), sum(d.mean_token_margin for d in got) / n, all(d.ended_with_eos for d in got))
                out.append((Attempt(page, det_idx, region, source="segmented", orientation=None), joined))
    return out


def merge_texts(pieces: list[str], longest: int = 24, tolerance: float = 0.34) -> str | None:
    """As :func:`quire.functions.text.merge_pieces`, on the worker."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    if not pieces:
        return None
    merged = pieces[0]
    for piece in pieces[1:]:
        best = (9.0, 0)
        for n in range(1, min(longest, len(merged), len(piece)) + 1):
            d = distance(merged[-n:], piece[:n]) / n
            if d <= (0 if n == 1 else tolerance) and (d < best[0] - 1e-9 or (abs(d - best[0]) <= 1e-9 and n > best[1])):
                best = (d, n)
        if not best[1] and merged and piece:
            return None
        merged += piece[best[1] :]
    return merged


def recognise_pages(boxes: DataFrame, make_scorer: Callable[[], Scorer], options: Options, page: str = "page_id", angle: Callable[[Attempt], float | None] | None = None) -> DataFrame:
    """Candidates of all lines: page, det_idx, ord and the fields of a candidate, and ``extra`` (recognitions so far).

    ``boxes`` has page, det_idx, x, y, width, height, the padded region as px, py, pwidth, pheight, and may have
    ``has_crops``. ``make_scorer`` runs once per task, so a model is loaded once; only its own code travels.
    """
    key = boxes.schema[page].dataType.simpleString()
    shape = (
        f"{page} {key}, det_idx long, ord int, text string, recognition_score double, minimum_token_score double, mean_token_margin double, eos_score double, "
        "ended_with_eos boolean, source string, preprocessing string, orientation string, deskew_angle double, extra int"
    )
    names = [part.strip().split(" ")[0] for part in shape.split(",")]
    crops = "has_crops" in boxes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, budget, current = make_scorer(), Budget(options.max_extra_recognitions), object()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r[page] != current:
                    current, budget = r[page], Budget(options.max_extra_recognitions)
                region, padded = tuple(r[c] for c in ("x", "y", "width", "height")), tuple(r[c] for c in ("px", "py", "pwidth", "pheight"))
                found = recognise_line(str(r[page]), r["det_idx"], region, padded, scorer, options, budget, bool(r["has_crops"]) if crops else False, angle, merge_texts)
                for k, (a, d) in enumerate(found):
                    rows.append((r[page], r["det_idx"], k, d.text, d.recognition_score, d.minimum_token_score, d.mean_token_margin, d.eos_score, d.ended_with_eos, a.source, a.preprocessing, a.orientation, a.deskew_angle, budget.attempts))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = list(to_arrow_schema(_parse_datatype_string(shape)).types)
    # pages in order within a partition: one exchange by page, and a sort
    return boxes.repartition(page).sortWithinPartitions(page, "det_idx").mapInArrow(run, shape)


def with_fallback(primary: Callable, fallback: Callable, aborted: Callable[[], bool] = lambda: False, told: Callable[[Exception], None] | None = None):
    """Call ``primary``; if it fails and the run was not aborted, tell and call ``fallback``."""
    try:
        return primary()
    except Exception as error:
        if aborted() or isinstance(error, InterruptedError):
            raise
        if told:
            told(error)
        return fallback()
