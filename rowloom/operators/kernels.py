"""Small array kernels for page images, and the Arrow functions that run them on columns.

Images are columns ``h``, ``w`` and ``gray`` (bytes, a row after another). Each kernel works on
one image; Spark deals the images, and all decisions on their results are made with columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a row mask and where it is sampled: shares of the row's width and height (fixed values).
MASK_W, MASK_H = 170, 24
MASK_X, MASK_Y = (0.108, 0.575), (0.08, 0.85)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at fractional places, edges held."""
    h, w = image.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    return top * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def row_mask(image: np.ndarray) -> np.ndarray:
    """Ink of a row's name band as MASK_H x MASK_W bits; all clear where there is too little or too much ink.

    The median is the background; ink is darker on a bright one and brighter on a dark one, by
    a margin that follows the spread of the values.
    """
    h, w = image.shape
    x = w * (MASK_X[0] + (MASK_X[1] - MASK_X[0]) * (np.arange(MASK_W) + 0.5) / MASK_W)
    y = h * (MASK_Y[0] + (MASK_Y[1] - MASK_Y[0]) * (np.arange(MASK_H) + 0.5) / MASK_H)
    band = bilinear(image.astype(float), *np.meshgrid(x, y))
    ground = np.median(band)
    margin = max(24.0, 0.35 * (np.percentile(band, 98) - ground if ground <= 140 else ground - np.percentile(band, 2)))
    mask = band < ground - margin if ground > 140 else band > ground + margin
    return mask if 36 <= mask.sum() <= 0.46 * mask.size else np.zeros_like(mask)


def shifted_dice(a: np.ndarray, b: np.ndarray, dx: int, dy: int) -> float:
    moved = np.zeros_like(b)
    h, w = b.shape
    moved[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = b[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    total = a.sum() + b.sum()
    return 2.0 * (a & moved).sum() / total if total else 0.0


def mask_match(a: np.ndarray, b: np.ndarray) -> float:
    """Best dice of two masks over shifts: rows by three first, then, if that is promising, columns by four; blank is 0."""
    if not a.any() or not b.any():
        return 0.0
    best, at = max((shifted_dice(a, b, 0, dy), -abs(dy), dy) for dy in range(-3, 4))[::2]
    if best < 0.53:
        return best
    return max([best, *(shifted_dice(a, b, dx, at + dy) for dx in (-4, -2, -1, 1, 2, 4) for dy in (-1, 0, 1))])


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum() + 1e-8))


def locate(image: np.ndarray, coarse: np.ndarray, fine: np.ndarray, scales: np.ndarray, step: int = 8, keep: int = 18) -> tuple[float, float, float, float]:
    """Score, x, y and scale where the template (rows of x, y, gray) fits best: a grid, then finer around its best."""

    def score(points: np.ndarray, x: float, y: float, s: float) -> float:
        return correlation(bilinear(image, x + points[:, 0] * s, y + points[:, 1] * s), points[:, 2])

    h, w = image.shape
    image = image.astype(float)
    tries = [(score(coarse, x, y, s), x, y, s) for s in scales for y in np.arange(0, h - coarse[:, 1].max() * s, step) for x in np.arange(0, w - coarse[:, 0].max() * s, step)]
    best = sorted(tries, reverse=True)[:keep]
    while step > 1:
        step //= 2
        near = {(x + dx * step, y + dy * step, s * k) for _, x, y, s in best for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in (0.99, 1.0, 1.01)}
        best = sorted(((score(fine, *p), *p) for p in near), reverse=True)[: max(2, keep // 4)]
    return best[0]


def panel(image: np.ndarray, width: int = 240) -> tuple[int, int, int, int]:
    """x, y, w, h of the largest dark region that looks like a panel, else of the whole image."""
    h, w = image.shape
    scale = width / w if w > width else 1.0
    rows, cols = max(1, int(h * scale)), max(1, int(w * scale))
    small = bilinear(image.astype(float), *np.meshgrid((np.arange(cols) + 0.5) / scale - 0.5, (np.arange(rows) + 0.5) / scale - 0.5)) < 90
    label = np.where(small, np.arange(small.size).reshape(small.shape) + 1, 0)
    while True:  # neighbours take the largest label until none changes
        new = label.copy()
        new[1:] = np.maximum(new[1:], label[:-1])
        new[:-1] = np.maximum(new[:-1], label[1:])
        new[:, 1:] = np.maximum(new[:, 1:], label[:, :-1])
        new[:, :-1] = np.maximum(new[:, :-1], label[:, 1:])
        new[~small] = 0
        if (new == label).all():
            break
        label = new
    best, box = 0, (0, 0, w, h)
    for i in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == i)
        bw, bh = np.ptp(xs) + 1, np.ptp(ys) + 1
        if len(ys) > best and ys.min() <= 0.2 * rows and bw >= 1.35 * bh and bw * bh >= 0.08 * rows * cols and bw <= 0.92 * cols:
            best, box = len(ys), (round(xs.min() / scale), round(ys.min() / scale), round(bw / scale), round(bh / scale))
    return box


def row_pitch(profile: np.ndarray, low: int = 25, high: int = 55) -> tuple[int, float]:
    """The lag with the highest normalised autocorrelation of an ink profile less its smooth course, of equals the first."""
    near = np.arange(-24, 25)
    bell = np.exp(-(near**2) / (2 * 8.0**2))
    x = profile - np.convolve(profile, bell / bell.sum(), "same")
    scores = [(x[:-k] * x[k:]).sum() / np.sqrt((x[:-k] ** 2).sum() * (x[k:] ** 2).sum() + 1e-8) for k in range(low, min(high, len(x) - 1) + 1)]
    at = int(np.argmax(scores))
    return low + at, float(scores[at])


def glyph_score(line: np.ndarray, glyphs: np.ndarray, origin: float, pitch: float = 16.0) -> float:
    """Mean likeness of a line to a sequence of glyphs over five starts, less for ink that trails behind the last."""
    h, w = line.shape
    side = int(np.sqrt(glyphs.shape[1]))
    best = -1.0
    for shift in range(-2, 3):
        parts = [bilinear(line, *np.meshgrid(origin + shift + i * pitch + np.linspace(0, pitch - 1, side), np.linspace(0, h - 1, side))).ravel() for i in range(len(glyphs))]
        rest = line[:, min(w, int(origin + shift + len(glyphs) * pitch)) :]
        trail = 0.25 if (rest > 140).sum() >= 12 else 0.0
        best = max(best, float(np.mean([correlation(p, g) for p, g in zip(parts, glyphs, strict=True)])) - trail)
    return best


def mask_column(h: Column, w: Column, gray: Column) -> Column:
    """Packed bits of row_mask() for a column of row images."""

    @F.pandas_udf("binary")
    def masks(hs: pd.Series, ws: pd.Series, grays: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else np.packbits(row_mask(np.frombuffer(g, np.uint8).reshape(int(a), int(b)))).tobytes() for a, b, g in zip(hs, ws, grays, strict=True)])

    return masks(h, w, gray)


def mask_score(a: Column, b: Column) -> Column:
    """mask_match() of two columns of packed masks, for the overlap rules; null counts as blank."""

    @F.pandas_udf("double")
    def scores(left: pd.Series, right: pd.Series) -> pd.Series:
        def bits(m):
            return np.unpackbits(np.frombuffer(m, np.uint8)).astype(bool).reshape(MASK_H, MASK_W)

        return pd.Series([0.0 if x is None or y is None else mask_match(bits(x), bits(y)) for x, y in zip(left, right, strict=True)], dtype=float)

    return scores(a, b)


def cut_rows(pages: DataFrame, most: int = 11) -> DataFrame:
    """Row images of page images (batch, page, h, w, gray): the panel's rows by their pitch, at most ``most``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for batch, page, h, w, gray in pdf[["batch", "page", "h", "w", "gray"]].itertuples(index=False):
                image = np.frombuffer(gray, np.uint8).reshape(h, w)
                x, y, bw, bh = panel(image)
                inner = image[y : y + bh, x : x + bw]
                pitch, _ = row_pitch(np.abs(np.diff(inner.astype(float), axis=1)).sum(axis=1))
                for i in range(min(most, bh // pitch)):
                    part = inner[i * pitch : (i + 1) * pitch, : int(0.69 * bw)]
                    out.append((batch, page, i + 1, part.shape[0], part.shape[1], part.tobytes()))
            yield pd.DataFrame(out, columns=["batch", "page", "row", "h", "w", "gray"])

    return pages.select("batch", "page", "h", "w", "gray").mapInPandas(cut, "batch string, page long, row int, h int, w int, gray binary")
