"""Measures of pixels, as numpy on whole images; rows of Spark's ``image`` source
hold BGR bytes.  Resizing is nearest-neighbour, an approximation where another
kind was meant."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 720


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Height by width by 3, RGB."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of 8 bits by integer weights."""
    r, g, b = (rgb[:, :, i].astype(np.int32) for i in range(3))
    return ((77 * r + 150 * g + 29 * b) >> 8).astype(np.uint8)


def shrink(a: np.ndarray, side: int) -> np.ndarray:
    h, w = a.shape[:2]
    if max(h, w) <= side:
        return a
    nh, nw = max(1, round(h * side / max(h, w))), max(1, round(w * side / max(h, w)))
    return a[(np.arange(nh) * h // nh)[:, None], (np.arange(nw) * w // nw)[None, :]]


def quality(luma: np.ndarray) -> tuple[float, float, float]:
    """Brightness, contrast (population deviation) and sharpness (mean of absolute differences)."""
    x = shrink(luma, LIMIT).astype(float)
    dx = np.abs(np.diff(x, axis=1)).mean() if x.shape[1] > 1 else 0.0
    dy = np.abs(np.diff(x, axis=0)).mean() if x.shape[0] > 1 else 0.0
    return float(x.mean()), float(x.std()), float((dx + dy) / 2)


def sharp_score(luma: np.ndarray, half: float = 550.0) -> float:
    """Variance v of the Laplacian as v / (v + half)."""
    x = luma.astype(float)
    if min(x.shape) < 3:
        return 0.0
    lap = 4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
    v = lap.var()
    return float(v / (v + half))


def edge_density(luma: np.ndarray, least: int = 42) -> float:
    x = luma.astype(np.int32)
    if min(x.shape) < 2:
        return 0.0
    return float((np.abs(np.diff(x, axis=1))[:-1] + np.abs(np.diff(x, axis=0))[:, :-1] > least).mean())


def chroma(rgb: np.ndarray) -> float:
    return float((rgb.max(axis=2).astype(int) - rgb.min(axis=2)).mean())


def signature(luma: np.ndarray, grid: int = 8) -> np.ndarray | None:
    """Means of a grid, their mean removed, of unit length; null for flat or small ones."""
    h, w = luma.shape
    if h < grid or w < grid:
        return None
    rows, cols = np.arange(grid) * h // grid, np.arange(grid) * w // grid
    sums = np.add.reduceat(np.add.reduceat(luma.astype(np.int64), rows, axis=0), cols, axis=1)
    size = np.diff([*rows, h])[:, None] * np.diff([*cols, w])[None, :]
    cells = (sums / size).ravel()
    cells = cells - cells.mean()
    n = np.linalg.norm(cells)
    return None if n < 1e-6 else cells / n


def block_match(prev: np.ndarray, now: np.ndarray, reach: int = 10, step: int = 2, penalty: float = 0.4) -> tuple[int, int, float]:
    """Shift of ``now`` against ``prev`` of the least mean difference, and a
    confidence: lower at the border of the search and where costs are alike."""
    h, w = now.shape
    a, b = prev.astype(np.int32), now.astype(np.int32)
    costs = {}
    for dy in range(-reach, reach + 1, step):
        for dx in range(-reach, reach + 1, step):
            pa = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
            pb = b[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
            costs[dx, dy] = int(np.abs(pa - pb).sum()) // pa.size if pa.size else 1 << 30
    (dx, dy), best = min(costs.items(), key=lambda kv: (kv[1], abs(kv[0][0]) + abs(kv[0][1]), kv[0]))
    mean = sum(costs.values()) / len(costs)
    sure = max(0.0, 1 - best / mean) if mean else 0.0
    return dx, dy, sure * (penalty if reach in (abs(dx), abs(dy)) else 1.0)


def plain_background(rgb: np.ndarray, loose: bool = False) -> bool:
    """Little colour and little structure; ``loose`` is the mining variant."""
    luma = grey(rgb)
    top, low = rgb.max(axis=2).astype(float), rgb.min(axis=2).astype(float)
    sat = float(np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0).mean())
    x = luma.astype(float)
    lap = (4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]).var() if min(x.shape) > 2 else 0.0
    std, edges = float(x.std()), edge_density(luma)
    if loose:
        return sat < 50 and ((lap < 90 and std < 38) or (std < 18 and edges < 0.03))
    return (sat < 45 and (lap < 55 or std < 30)) or (sat < 35 and std < 18 and edges < 0.03)


def rotate(a: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by a quarter turn's multiple."""
    return np.rot90(a, -(degrees // 90) % 4)


MEASURES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("brightness", "contrast", "sharpness", "sharp_score", "edge_density", "chroma")]
    + [T.StructField("signature", T.ArrayType(T.DoubleType())), T.StructField("plain", T.BooleanType())]
)


@F.pandas_udf(MEASURES)
def measures_udf(image: pd.DataFrame) -> pd.DataFrame:
    """All measures of an ``image`` struct of Spark's image source."""
    rows = []
    for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
        rgb = decode(h, w, c, data)
        luma = grey(rgb)
        sig = signature(luma)
        rows.append((*quality(luma), sharp_score(luma), edge_density(luma), chroma(rgb), None if sig is None else sig.tolist(), plain_background(rgb)))
    return pd.DataFrame(rows, columns=[f.name for f in MEASURES])


def area_shrink(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over equal cells, with shares of the pixels at their rims."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        lo, hi = np.maximum(edge[:-1, None], np.arange(n)[None]), np.minimum(edge[1:, None], np.arange(1, n + 1)[None])
        return np.maximum(hi - lo, 0) * m / n

    return np.tensordot(np.tensordot(weights(a.shape[0], h), a.astype(float), 1), weights(a.shape[1], w), ((1,), (1,))) if a.ndim == 2 else np.stack(
        [area_shrink(a[:, :, i], h, w) for i in range(a.shape[2])], axis=2
    )


def digest(rgb: np.ndarray, side: int = 24, length: int = 12) -> str:
    """Of a small grey version, so that equal crops have equal digests."""
    small = np.floor(area_shrink(rgb, side, side) + 0.5).astype(np.uint8)
    return hashlib.sha1(grey(small).tobytes()).hexdigest()[:length]


def components(mask: np.ndarray) -> np.ndarray:
    """(height, width, area) of the 8-connected parts of a mask, by joining runs of rows."""
    root: list[int] = []
    boxes: list[list[int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            me = len(root)
            root.append(me)
            boxes.append([y, y, a, b - 1, b - a])
            for pa, pb, other in above:
                if pa <= b and a <= pb:
                    root[find(me)] = find(other)
            here.append((a, b, me))
        above = here
    merged: dict[int, list[int]] = {}
    for i, (y1, y2, x1, x2, n) in enumerate(boxes):
        m = merged.setdefault(find(i), [y1, y2, x1, x2, 0])
        m[:] = [min(m[0], y1), max(m[1], y2), min(m[2], x1), max(m[3], x2), m[4] + n]
    return np.array([[m[1] - m[0] + 1, m[3] - m[2] + 1, m[4]] for m in merged.values()]).reshape(-1, 3)


def reading_score(luma: np.ndarray) -> float:
    """How well a crop may read: structure, edges and letter-like parts.  Edges and
    the local threshold (a mean over 31 pixels, less 7) are approximations."""
    x = luma.astype(float)
    if min(x.shape) < 3:
        return 0.0
    lap = 4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
    small = area_shrink(x, x.shape[0] // 2, x.shape[1] // 2) if min(x.shape) > 80 else x
    padded = np.pad(small, 15, mode="edge")
    sums = np.cumsum(np.cumsum(np.pad(padded, ((1, 0), (1, 0))), axis=0), axis=1)
    mean = (sums[31:, 31:] - sums[:-31, 31:] - sums[31:, :-31] + sums[:-31, :-31]) / 961
    h, w = small.shape
    parts = components(small < mean - 7)
    letters = (parts[:, 1] >= 3) & (parts[:, 1] <= w * 0.35) & (parts[:, 0] >= 3) & (parts[:, 0] <= h * 0.25) & (parts[:, 2] >= 4) & (parts[:, 2] <= w * h * 0.08)
    return float(lap.var() + edge_density(luma, 160) * 3000 + int(letters.sum()) * 4)


@F.pandas_udf(T.StructType([T.StructField("digest", T.StringType()), T.StructField("reading", T.DoubleType())]))
def crop_udf(image: pd.DataFrame) -> pd.DataFrame:
    """Digest and reading score of an ``image`` struct."""
    rows = [decode(h, w, c, d) for h, w, c, d in zip(image["height"], image["width"], image["nChannels"], image["data"])]
    return pd.DataFrame([(digest(r), reading_score(grey(r))) for r in rows], columns=["digest", "reading"])


@F.pandas_udf(T.StructType([T.StructField("dx", T.IntegerType()), T.StructField("dy", T.IntegerType()), T.StructField("sure", T.DoubleType())]))
def motion_udf(now: pd.Series, prev: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Shift of a frame's luma against the one before; none without one."""
    out = []
    for n, p, h, w in zip(now, prev, height, width):
        if p is None or n is None or len(p) != len(n):
            out.append((0, 0, -1.0))
            continue
        out.append(block_match(*(np.frombuffer(x, np.uint8).reshape(int(h), int(w)) for x in (p, n))))
    return pd.DataFrame(out, columns=["dx", "dy", "sure"])
