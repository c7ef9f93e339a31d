"""Raster kernels of page images, in numpy: grey, thresholds, skew, rules and grids.

Images are uint8 arrays (height, width) or (height, width, 3 as blue, green, red). ``measure`` runs them over rows of
(doc_id, page_no, height, width, pixels); decoding files into pixels is an adapter's part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Least and greatest skew that is corrected; window, k and r of the local threshold; length of a table rule;
# shares of the page that rules and kernels span.
SKEW_FLOOR, SKEW_LIMIT, WINDOW, K, R, RULE = 0.5, 5.0, 41, 0.2, 128.0, 60
ROW_SPAN, COL_SPAN, ROW_KERNEL, COL_KERNEL, LEAST_KERNEL, GAP = 0.25, 0.20, 0.05, 0.08, 20, 4


def to_grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(grey: np.ndarray) -> int:
    """The threshold with the greatest variance between the classes at most it and above it."""
    count = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((mass[-1] * below / below[-1] - mass) ** 2 / (below * above))
    return int(between.argmax())


def contrast(grey: np.ndarray) -> float | None:
    """Mean paper less mean ink, on a scale of 0 to 1."""
    t = otsu(grey)
    ink, paper = grey[grey <= t], grey[grey > t]
    return float(paper.mean() - ink.mean()) / 255 if ink.size and paper.size else None


def sauvola(grey: np.ndarray, window: int = WINDOW, k: float = K, r: float = R) -> np.ndarray:
    """255 where a pixel is brighter than its surroundings' threshold."""
    window += window % 2 == 0
    v, half = grey.astype(np.float64), window // 2

    def box(x: np.ndarray) -> np.ndarray:
        mode = "reflect" if min(x.shape) > half else "edge"
        s = np.pad(np.cumsum(np.cumsum(np.pad(x, half, mode=mode), 0), 1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    mean = box(v)
    std = np.sqrt(np.maximum(box(v * v) - mean * mean, 0))
    return np.where(v > mean * (1 + k * (std / r - 1)), 255, 0).astype(np.uint8)


def _slide(x: np.ndarray, n: int, axis: int, outside: bool, every: bool) -> np.ndarray:
    """Whether every (or any) pixel of the n around each is set."""
    x = np.moveaxis(x, axis, 1)
    before = n // 2 if every else n - 1 - n // 2
    c = np.pad(np.cumsum(np.pad(x, ((0, 0), (before, n - 1 - before)), constant_values=outside), 1, dtype=np.int64), ((0, 0), (1, 0)))
    hits = c[:, n:] - c[:, :-n]
    return np.moveaxis(hits == n if every else hits > 0, 1, axis)


def opened(ink: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Ink in runs of at least n pixels along an axis; the page's edge counts as ink."""
    return _slide(_slide(ink, n, axis, True, True), n, axis, False, False) & ink


def close_dots(binary: np.ndarray, size: int = 2) -> np.ndarray:
    """Paper gaps of less than ``size`` pixels closed."""
    paper = binary > 0
    for axis in (0, 1):
        paper = opened(paper, size, axis)
    return np.where(paper, 255, 0).astype(np.uint8)


def remove_rules(binary: np.ndarray, length: int = RULE) -> np.ndarray:
    ink = binary == 0
    for axis in (0, 1):
        ink = ink & ~opened(ink, length, axis)
    return np.where(ink, 0, 255).astype(np.uint8)


def _hull(points: np.ndarray) -> np.ndarray:
    p = sorted(map(tuple, np.unique(points, axis=0)))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    half = []
    for order in (p, p[::-1]):
        h: list[tuple[int, int]] = []
        for q in order:
            while len(h) > 1 and turn(h[-2], h[-1], q) <= 0:
                h.pop()
            h.append(q)
        half += h[:-1]
    return np.array(half or p, float)


def measure_skew(image: np.ndarray) -> float | None:
    """The angle of the smallest rectangle around the ink, in degrees from -45 to 45; none without ink. Advisory only."""
    grey = to_grey(image)
    ink = grey <= otsu(grey)
    if not ink.any() or ink.all():
        return None
    rows = np.flatnonzero(ink.any(1))  # the hull needs the outer ink of each row only
    left, right = ink[rows].argmax(1), ink.shape[1] - 1 - ink[rows][:, ::-1].argmax(1)
    h = _hull(np.concatenate([np.stack([left, rows], 1), np.stack([right, rows], 1)]))
    edge = np.roll(h, -1, 0) - h
    angles = np.unique(np.round(np.arctan2(edge[:, 1], edge[:, 0]) % (np.pi / 2), 9))
    best = min(angles, key=lambda a: (lambda q: np.ptp(q[:, 0]) * np.ptp(q[:, 1]))(h @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])))
    degrees = float(np.degrees(best))
    return degrees - 90 if degrees > 45 else degrees


def deskew(image: np.ndarray) -> np.ndarray:
    """Turned by its skew, where that is neither too small nor too large."""
    angle = measure_skew(image)
    if angle is None or not SKEW_FLOOR <= abs(angle) <= SKEW_LIMIT:
        return image
    h, w = image.shape[:2]
    a, cy, cx = np.radians(angle), h / 2, w / 2
    y, x = np.mgrid[:h, :w]
    sx, sy = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx, np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
    sx, sy = np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), max(0, w - 2)), np.minimum(sy.astype(int), max(0, h - 2))
    fx, fy = sx - x0, sy - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    top, bottom = image[y0, x0] * (1 - fx) + image[y0, x1] * fx, image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)


def prepare(image: np.ndarray, dot_matrix: bool, strip_rules: bool = False) -> np.ndarray:
    """Dot-matrix pages only in grey; others straightened and thresholded, without rules if asked."""
    grey = to_grey(image)
    if dot_matrix:
        return grey
    binary = sauvola(deskew(grey))
    return remove_rules(binary) if strip_rules else binary


def _runs(projection: np.ndarray, least: float) -> list[int]:
    hits = np.flatnonzero(projection >= least)
    return [int(x.mean()) for x in np.split(hits, np.flatnonzero(np.diff(hits) > GAP) + 1) if len(x)]


def detect_grid(binary: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Row and column bands between the long rules of a page that still has them."""
    h, w = binary.shape
    ink = binary == 0
    across = _runs(opened(ink, max(LEAST_KERNEL, int(w * ROW_KERNEL)), 1).sum(1), w * ROW_SPAN)
    down = _runs(opened(ink, max(LEAST_KERNEL, int(h * COL_KERNEL)), 0).sum(0), h * COL_SPAN)
    return [(a, b) for a, b in zip(across, across[1:]) if b - a > 8], [(a, b) for a, b in zip(down, down[1:]) if b - a > 15]


def measure(images: DataFrame) -> DataFrame:
    """skew, contrast and the number of row bands of each image (doc_id, page_no, height, width, pixels)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                grey = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
                rows.append((r.doc_id, r.page_no, measure_skew(grey), contrast(grey), len(detect_grid(np.where(grey <= otsu(grey), 0, 255))[0])))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "skew", "contrast", "row_bands"])

    return images.select("doc_id", "page_no", "height", "width", "pixels").mapInPandas(run, "doc_id string, page_no int, skew double, contrast double, row_bands int")
