"""Kernels on rasters held as arrays of numbers with a height and a width, for use in UDFs over image columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Intersection over union, and Dice. Two empty masks agree wholly."""
    a, b = np.asarray(a, bool), np.asarray(b, bool)
    if a.shape != b.shape:
        raise ValueError("masks differ in shape")
    both, either, total = np.count_nonzero(a & b), np.count_nonzero(a | b), np.count_nonzero(a) + np.count_nonzero(b)
    return (both / either if either else 1.0), (2 * both / total if total else 1.0)


def visible_vegetation(rgb: np.ndarray) -> np.ndarray:
    """(green - red) / (green + red - blue), 0 where that has no value; 0-255 or 0-1."""
    x = np.asarray(rgb, np.float32)
    if x.size and x.max() > 1:
        x = x / np.float32(255)
    top, bottom = x[..., 1] - x[..., 0], x[..., 1] + x[..., 0] - x[..., 2]
    ok = np.abs(bottom) > 1e-6
    return np.where(ok, top / np.where(ok, bottom, 1), 0).astype(np.float32)


def best_threshold(index: list[np.ndarray], truth: list[np.ndarray], candidates: np.ndarray) -> tuple[float, float]:
    """The first candidate with the greatest mean overlap, and that overlap."""
    means = [float(np.mean([overlap(i > c, m)[0] for i, m in zip(index, truth, strict=True)])) for c in candidates]
    k = int(np.argmax(means))
    return float(candidates[k]), means[k]


def grid_cells(mask: np.ndarray, grid: int, least: float, half_even: bool = False) -> list[str]:
    """Cells "row,column" whose share of the mask is at least `least`. Edges are rounded down, or half to even."""
    mask = np.asarray(mask, bool)
    edge = (lambda k, n: round(k * n / grid)) if half_even else (lambda k, n: k * n // grid)
    ys, xs = ([edge(k, n) for k in range(grid + 1)] for n in mask.shape)
    cells = ((r, c, mask[ys[r] : ys[r + 1], xs[c] : xs[c + 1]]) for r in range(grid) for c in range(grid))
    return [f"{r},{c}" for r, c, part in cells if part.size and part.mean() >= least]


def components(mask: np.ndarray) -> list[int]:
    """Sizes of four-connected parts, in the order of their first pixel. Runs of each row are joined to those they
    touch in the row above."""
    mask = np.asarray(mask, bool)
    parent: list[int] = []
    size: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above: list[tuple[int, int, int]] = []
    for row in mask:
        flips = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        here = []
        for start, stop in flips.reshape(-1, 2).tolist():
            own = len(parent)
            parent.append(own)
            size.append(stop - start)
            for a, b, other in above:
                if a < stop and start < b and (x := find(other)) != (y := find(own)):
                    parent[max(x, y)] = min(x, y)
                    size[min(x, y)] += size[max(x, y)]
            here.append((start, stop, own))
        above = here
    return [size[k] for k in range(len(parent)) if parent[k] == k]


def border_distances(mask: np.ndarray) -> tuple[float, float]:
    """Nearest and farthest distance of mask pixels from the frame's border, 0 without any."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return 0.0, 0.0
    h, w = mask.shape
    d = np.minimum(np.minimum(ys, h - 1 - ys), np.minimum(xs, w - 1 - xs))
    return float(d.min()), float(d.max())


def sharpness(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, borders mirrored without their own line."""
    g = np.pad(np.asarray(gray, np.float64), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def exposure(gray: np.ndarray) -> dict[str, float]:
    g = np.asarray(gray, np.float64)
    return {"luminance_mean": g.mean() / 255, "contrast_std": g.std() / 255, "clipped_dark": (g <= 3).mean(), "clipped_bright": (g >= 252).mean()}


def mask_udf(kernel: Callable[[np.ndarray], object], kind: str):
    """A column function (pixels, height, width) -> kernel's value; NULL for a missing or ill-sized raster."""

    @F.pandas_udf(kind)
    def apply(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for p, h, w in zip(pixels, height, width):
            out.append(None if p is None or len(p) != int(h or 0) * int(w or 0) else kernel(np.asarray(p).reshape(int(h), int(w))))
        return pd.Series(out, dtype=object)

    return apply
