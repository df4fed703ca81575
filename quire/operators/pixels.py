"""Image kernels over arrays of luminance or RGB, per image.

Images come already resized: resampling belongs to the decoder before. Kernels are numpy; :func:`map_images` applies one
to a table of images (width, height, pixels) in Arrow batches, an image at a time, so memory is bounded by an image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Box = tuple[float, float, float, float]

# Weights of the channels in the luminance.
WEIGHTS = np.array([0.299, 0.587, 0.114])


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Luminance of an array whose last axis is red, green, blue (further channels are ignored)."""
    return rgb[..., :3].astype(float) @ WEIGHTS


def floor_percentile(values: np.ndarray, fraction: float, empty: float = 0.0) -> float:
    flat = np.sort(values, axis=None)
    return float(flat[int(np.floor((len(flat) - 1) * fraction))]) if len(flat) else empty


def upper_median(values: np.ndarray, empty: float = 255.0) -> float:
    flat = np.sort(values, axis=None)
    return float(flat[len(flat) // 2]) if len(flat) else empty


def to_bytes(v: np.ndarray) -> np.ndarray:
    """Clamp to 0..255 and round halves to even, as a clamped byte array stores numbers."""
    return np.rint(np.clip(v, 0, 255)).astype(np.uint8)


def half_up(v: float) -> int:
    return int(np.floor(v + 0.5))


def box_average(gray: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the square of ``radius`` around each pixel, cut at the edges, from a summed-area table."""
    h, w = gray.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = gray.cumsum(axis=0).cumsum(axis=1)
    y0, y1 = np.maximum(0, np.arange(h) - radius), np.minimum(h - 1, np.arange(h) + radius) + 1
    x0, x1 = np.maximum(0, np.arange(w) - radius), np.minimum(w - 1, np.arange(w) + radius) + 1
    total = table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def _stretch(v: np.ndarray) -> np.ndarray:
    low = floor_percentile(v, 0.02)
    high = max(low + 1, floor_percentile(v, 0.98))
    return to_bytes((v - low) * 255 / (high - low))


def grayscale_contrast(rgb: np.ndarray) -> np.ndarray:
    """Luminance stretched between its 2nd and 98th percentile."""
    return _stretch(luminance(rgb))


def background_normalized(rgb: np.ndarray) -> np.ndarray:
    """Difference to the local mean (radius 6 % of the short side), times 2.4, around 128."""
    gray = luminance(rgb)
    return to_bytes(128 + (gray - box_average(gray, max(2, half_up(min(gray.shape) * 0.06)))) * 2.4)


def ink_channel(rgb: np.ndarray) -> np.ndarray:
    """The channel of the widest spread between its 5th and 95th percentile, stretched; ties go to the first."""
    spread = [floor_percentile(rgb[..., c], 0.95) - floor_percentile(rgb[..., c], 0.05) for c in range(3)]
    return _stretch(rgb[..., int(np.argmax(spread))].astype(float))


def adaptive_binary(rgb: np.ndarray) -> np.ndarray:
    """Black where the luminance is below 90 % of the local mean (radius 3.5 % of the short side), else white."""
    gray = luminance(rgb)
    mean = box_average(gray, max(2, half_up(min(gray.shape) * 0.035)))
    return np.where(gray < mean * 0.9, 0, 255).astype(np.uint8)


FILTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "grayscale-contrast": grayscale_contrast,
    "background-normalized": background_normalized,
    "ink-channel": ink_channel,
    "adaptive-binary": adaptive_binary,
}


def rotate(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Rotate about the centre on a white ground that holds the whole image, with bilinear sampling."""
    if not np.isfinite(degrees) or abs(degrees) < 0.001:
        return gray
    a = np.deg2rad(degrees)
    h, w = gray.shape
    c, s = np.cos(a), np.sin(a)
    W, H = max(1, int(np.ceil(abs(w * c) + abs(h * s)))), max(1, int(np.ceil(abs(w * s) + abs(h * c))))
    y, x = np.mgrid[0:H, 0:W]
    dx, dy = x + 0.5 - W / 2, y + 0.5 - H / 2
    sx, sy = c * dx + s * dy + w / 2 - 0.5, -s * dx + c * dy + h / 2 - 0.5
    padded = np.pad(gray.astype(float), 1, constant_values=255.0)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    at = lambda j, i: padded[np.clip(j + 1, 0, h + 1), np.clip(i + 1, 0, w + 1)]
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def orient(gray: np.ndarray, orientation: str = "auto") -> np.ndarray:
    """A quarter turn counter-clockwise for ``rotate-90``, and for ``auto`` if the image is taller than wide."""
    return np.rot90(gray) if orientation == "rotate-90" or (orientation == "auto" and gray.shape[0] > gray.shape[1]) else gray


def projection_score(gray: np.ndarray) -> float:
    """Population variance of the mean darkness of the rows: high when lines of text lie level."""
    return float((255 - gray).mean(axis=1).var()) if gray.size else 0.0


def rank_deskew_angles(gray: np.ndarray, orientation: str = "auto", angles: tuple[float, ...] = (-3, -1.5, 0, 1.5, 3)) -> list[float]:
    """Angles by descending projection score, then by size, then in the given order."""
    base = orient(gray, orientation)
    scored = [(-projection_score(rotate(base, a)), abs(a), k, a) for k, a in enumerate(angles) if np.isfinite(a)]
    return [a for *_, a in sorted(scored)]


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """4-connected components of a mask: (area, x0, y0, x1, y1), in order of their first pixel. Runs of rows are joined."""
    h, w = mask.shape
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs: list[tuple[int, int, int]] = []
    last: list[int] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        own, k = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = len(parent)
            parent.append(i)
            runs.append((y, a, b))
            own.append(i)
            while k < len(last) and runs[last[k]][2] <= a:
                k += 1
            j = k
            while j < len(last) and runs[last[j]][1] < b:
                p, q = root(last[j]), root(i)
                parent[max(p, q)] = min(p, q)
                j += 1
        last = own
    out: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(runs):
        c = out.setdefault(root(i), [0, a, y, b - 1, y])
        c[0] += b - a
        c[1], c[3], c[4] = min(c[1], a), max(c[3], b - 1), y
    return [tuple(c) for _, c in sorted(out.items())]


def _regions(found: list[tuple[int, int, int, int, int]], scale: float, most: int) -> tuple[list[Box], int]:
    best = sorted(found, key=lambda c: -c[0])[:most]
    return [(x0 / scale, y0 / scale, (x1 - x0 + 1) / scale, (y1 - y0 + 1) / scale) for _, x0, y0, x1, y1 in best], sum(c[0] for c in best)


def paper_mask(gray: np.ndarray, scale: float = 1.0, most: int = 8) -> tuple[list[Box], float]:
    """Regions that look like the border of the image, taken as paper, and the share that they cover.

    ``gray`` is the image at ``scale`` (192 pixels on the long side at most). Pixels within max(18, 3.5 deviations) of the
    border's median count; components under 1.5 % are dropped and the largest ``most`` stay.
    """
    h, w = gray.shape
    if not gray.size:
        return [], 0.0
    step = max(1, min(w, h) // 32)
    border = np.concatenate((gray[0, ::step], gray[-1, ::step], gray[::step, 0], gray[::step, -1]))
    middle = upper_median(border)
    limit = max(18.0, upper_median(np.abs(border - middle)) * 3.5)
    found = [c for c in components(np.abs(gray - middle) <= limit) if c[0] >= max(8, w * h * 0.015)]
    regions, covered = _regions(found, scale, max(1, most))
    return regions, min(1.0, covered / max(1, w * h))


def uncovered_ink(gray: np.ndarray, boxes: list[Box], scale: float = 1.0, most: int = 12) -> list[Box]:
    """Dark components outside all boxes, the largest first. ``gray`` is the image at ``scale`` (256 pixels at most)."""
    h, w = gray.shape
    dark = gray < min(180.0, upper_median(gray) - 18)
    y, x = np.mgrid[0:h, 0:w]
    for bx, by, bw, bh in boxes:
        dark &= ~((x >= bx * scale) & (x <= (bx + bw) * scale) & (y >= by * scale) & (y <= (by + bh) * scale))
    return _regions([c for c in components(dark) if c[0] >= max(3, w * h * 0.0002)], scale, most)[0]


def ink_projection(gray: np.ndarray) -> tuple[list[float], float, int] | None:
    """Darkness along a long line's crop: (samples, transverse size in samples, pixels per sample); None for short lines."""
    h, w = gray.shape
    line = gray if w > h else gray.T  # rows across the line, columns along it
    across, along = line.shape
    if along < across * 8 or across < 4:
        return None
    step, side = max(1, -(-along // 800)), max(1, -(-across // 64))
    samples = line[::side, ::step]
    ground = floor_percentile(samples, 0.82, 255.0)
    scale = max(14.0, (ground - floor_percentile(samples, 0.2, 255.0)) * 0.2)
    dark = np.clip((ground - samples) / scale, 0, 1).sum(axis=0) / max(1, -(-across // side))
    return dark.tolist(), across / step, step


def detector_input(rgb: np.ndarray, mean: tuple[float, ...] = (103.53, 116.28, 123.675), std: tuple[float, ...] = (57.375, 57.12, 58.395)) -> np.ndarray:
    """A square BGR tensor of an image already at the detector's size, padded with black, less mean over deviation."""
    h, w = rgb.shape[:2]
    square = np.zeros((max(h, w), max(h, w), 3))
    square[:h, :w] = rgb[..., 2::-1]
    return ((square - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def recognizer_input(rgb: np.ndarray) -> np.ndarray:
    """A tensor of a line image already at the recogniser's size, scaled to -1..1."""
    return (rgb[..., 2::-1].astype(np.float32) / 127.5 - 1).transpose(2, 0, 1)


def map_images(images: DataFrame, kernel: Callable[[np.ndarray], object], result: str | T.DataType, name: str = "result", channels: int = 1) -> DataFrame:
    """Columns of ``images`` but ``pixels``, with a kernel's result for each image.

    ``pixels`` is an array of numbers in rows, ``channels`` per pixel; null or short pixels give a null result.
    """
    kept = [c for c in images.columns if c != "pixels"]
    kind = T._parse_datatype_string(result) if isinstance(result, str) else result
    shape = T.StructType([*[images.schema[c] for c in kept], T.StructField(name, kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, w, h in zip(b.column("pixels"), b.column("width").to_pylist(), b.column("height").to_pylist(), strict=True):
                flat = np.asarray(p.values) if p.is_valid else np.zeros(0)
                size = w * h * channels if w and h else -1
                out.append(kernel(flat.reshape((h, w, channels) if channels > 1 else (h, w))) if len(flat) == size else None)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, arrow)], names=[*kept, name])

    return images.mapInArrow(run, shape)
