"""Raster kernels for one page or tile: warps, votes, smoothing and path clean-up in numpy.

Use them in ``mapInPandas`` over binary planes; none holds more than one page.
"""

from __future__ import annotations

import hashlib

import numpy as np


def affine(labels: np.ndarray, matrix: np.ndarray, shape: tuple[int, int], border: int = 0) -> np.ndarray:
    """Nearest-pixel warp; ``matrix`` (2 x 3) maps target x, y to source; outside is ``border``, also for masks."""
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    sx = np.rint(matrix[0, 0] * xs + matrix[0, 1] * ys + matrix[0, 2]).astype(int)
    sy = np.rint(matrix[1, 0] * xs + matrix[1, 1] * ys + matrix[1, 2]).astype(int)
    return remap(labels, sx, sy, border)


def remap(labels: np.ndarray, sx: np.ndarray, sy: np.ndarray, border: int = 0) -> np.ndarray:
    """Lookup of whole source positions."""
    inside = (sx >= 0) & (sy >= 0) & (sx < labels.shape[1]) & (sy < labels.shape[0])
    out = np.full(sx.shape, border, labels.dtype)
    out[inside] = labels[sy[inside], sx[inside]]
    return out


def rotation(shape: tuple[int, int], degrees: float) -> tuple[np.ndarray, tuple[int, int]]:
    """Matrix from target to source for a turn about the centre, and the shape that holds the turned page."""
    h, w = shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    new_w, new_h = int(np.ceil(round(w * abs(c) + h * abs(s), 9))), int(np.ceil(round(w * abs(s) + h * abs(c), 9)))
    cx, cy, tx, ty = (w - 1) / 2, (h - 1) / 2, (new_w - 1) / 2, (new_h - 1) / 2
    return np.array([[c, s, cx - c * tx - s * ty], [-s, c, cy + s * tx - c * ty]]), (new_h, new_w)


def scaling(from_shape: tuple[int, int], to_shape: tuple[int, int]) -> np.ndarray:
    """Matrix from target to source pixel centres."""
    fy, fx = from_shape[0] / to_shape[0], from_shape[1] / to_shape[1]
    return np.array([[fx, 0, (fx - 1) / 2], [0, fy, (fy - 1) / 2]])


def vote(labels: np.ndarray, shape: tuple[int, int], weights: np.ndarray) -> np.ndarray:
    """Every target cell gets the label of most weight that it covers anywhere; ties go to the lowest code."""
    rank = np.empty(len(weights), int)
    rank[np.lexsort((np.arange(len(weights)), -np.asarray(weights)))] = np.arange(len(weights))
    coded = rank[labels]

    def reduced(a: np.ndarray, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * len(a) / n
        return np.stack([a[int(np.floor(lo)) : max(int(np.ceil(hi)), int(np.floor(lo)) + 1)].min(0) for lo, hi in zip(edge[:-1], edge[1:], strict=True)])

    best = reduced(reduced(coded, shape[0]).T, shape[1]).T
    return np.argsort(rank)[best].astype(labels.dtype)


def mean_resize(grey: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Area average over whole cells."""

    def reduced(a: np.ndarray, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * len(a) / n
        total = np.concatenate((np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)))
        at = lambda e: total[int(e)] + (e - int(e)) * (a[min(int(e), len(a) - 1)])
        return np.stack([(at(hi) - at(lo)) / (hi - lo) for lo, hi in zip(edge[:-1], edge[1:], strict=True)])

    return reduced(reduced(np.asarray(grey, float), shape[0]).T, shape[1]).T


def sheet(shape: tuple[int, int], name: str, strength: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Source positions of a page bent like a cubic sheet; the bend follows from the name."""
    digest = hashlib.sha256(name.encode()).digest()
    a, b = ((int.from_bytes(digest[i : i + 8], "big") / 2**64 * 2 - 1) * strength for i in (0, 8))
    h, w = shape
    ys, xs = np.mgrid[:h, :w]
    t = xs / max(w - 1, 1)
    lift = (a + b) * t**3 - (2 * a + b) * t**2 + a * t  # slopes a and b at the sides, height 0 there
    return xs, np.rint(ys - lift * w).astype(int)


def simplified(path: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: points further than the tolerance from the chord stay."""
    path = np.asarray(path, float)
    keep = np.zeros(len(path), bool)
    keep[[0, -1]] = True
    todo = [(0, len(path) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, rel = path[b] - path[a], path[a + 1 : b] - path[a]
        n = np.hypot(*chord)
        d = np.abs(chord[0] * rel[:, 1] - chord[1] * rel[:, 0]) / n if n else np.hypot(*rel.T)
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return path[keep]


def line_angle(points: np.ndarray, orthogonal: bool = False) -> float | None:
    """Degrees of the main axis in (-90, 90]; against the vertical if ``orthogonal``; none for under three points. No sampling, so repeatable."""
    points = np.asarray(points, float)
    if len(points) < 3:
        return None
    axis = np.linalg.eigh(np.cov((points - points.mean(0)).T))[1][:, -1]
    phi = np.degrees(np.arctan2(axis[1], axis[0])) - (90 if orthogonal else 0)
    return float(90 - (90 - phi) % 180)


def extended(path: np.ndarray, share: float) -> np.ndarray:
    """A path made longer at both ends by a share of its length, along its end pieces."""
    path = np.asarray(path, float)
    add = share * np.hypot(*np.diff(path, axis=0).T).sum()
    unit = lambda v: v / np.hypot(*v) if np.hypot(*v) else v
    return np.vstack((path[0] + add * unit(path[0] - path[1]), path, path[-1] + add * unit(path[-1] - path[-2])))


def smoothed_at(path: np.ndarray, at: int, window: int = 5) -> np.ndarray:
    """The five points around a join replaced by running means; nothing near an end."""
    half = window // 2
    if at - 2 * half < 0 or at + 2 * half >= len(path):
        return np.asarray(path, float)
    out = np.array(path, float)
    for i in range(at - half, at + half + 1):
        out[i] = np.mean(path[i - half : i + half + 1], 0)
    return out


def drawn(shape: tuple[int, int], path: np.ndarray, thickness: float) -> np.ndarray:
    """Mask of the pixels within half the thickness (at least 2) of a path."""
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    out, reach = np.zeros(shape, bool), max(2.0, np.floor(thickness)) / 2
    for (ax, ay), (bx, by) in zip(path[:-1], path[1:], strict=True):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = np.clip(((xs - ax) * (bx - ax) + (ys - ay) * (by - ay)) / n, 0, 1) if n else np.zeros(shape)
        out |= np.hypot(xs - ax - t * (bx - ax), ys - ay - t * (by - ay)) <= reach
    return out
