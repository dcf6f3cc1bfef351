"""Bounded growth of regions: elliptical kernels, stoppers of several labels, specks left out, snapshots by round.

A page's seeds grow by dilation and closing and are cut at its stoppers in every round, so a region fills
its surroundings but crosses no separator. Beyond a page's edge there is nothing for a dilation and
everything for an erosion. Pages without seeds stay empty; null data counts as background.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .contours import borders, turning_cells
from .geometry import hull_of, parts_of
from .planes import _array


def ellipse(width: int, height: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of an elliptical kernel about its middle cell; an even side reaches one cell less to the right or below."""
    ry, rx = height // 2, width // 2
    out = []
    for i in range(height):
        dy = i - ry
        half = round(rx * np.sqrt(max(0, ry * ry - dy * dy) / (ry * ry))) if ry else rx
        out += [(dy, j - rx) for j in range(max(rx - half, 0), min(rx + half + 1, width))]
    return out


class Bits:
    """Masks of one shape as whole numbers, a bit a cell, so that a kernel is a few shifts of the whole mask. Behind each line are as many empty cells as the widest kernel reaches."""

    def __init__(self, shape: tuple[int, int], *kernels: list[tuple[int, int]]):
        self.shape = shape
        self.stride = shape[1] + max((abs(dx) for k in kernels for _, dx in k), default=0)
        self.inside = self.of(np.ones(shape, bool))

    def of(self, mask: np.ndarray) -> int:
        padded = np.zeros((self.shape[0], self.stride), bool)
        padded[:, : self.shape[1]] = mask
        return int.from_bytes(np.packbits(padded, bitorder="little").tobytes(), "little")

    def mask(self, bits: int) -> np.ndarray:
        cells = self.shape[0] * self.stride
        data = np.frombuffer(bits.to_bytes(-(-cells // 8), "little"), np.uint8)
        return np.unpackbits(data, count=cells, bitorder="little").reshape(-1, self.stride)[:, : self.shape[1]].astype(bool)

    def runs(self, kernel: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """A kernel as (place, length) of its runs along x."""
        out = []
        for dy, dx in sorted(kernel):
            if out and out[-1][0] == dy and out[-1][1] + out[-1][2] == dx:
                out[-1][2] += 1
            else:
                out.append([dy, dx, 1])
        return [(dy * self.stride + dx, n) for dy, dx, n in out]

    def spread(self, bits: int, runs: list[tuple[int, int]], rounds: int = 1) -> int:
        """Dilation; beyond the mask is nothing."""
        for _ in range(rounds):
            out = 0
            for place, length in runs:
                moved, held = bits >> place if place >= 0 else bits << -place, 1
                while held < length:
                    step = min(held, length - held)
                    moved, held = moved | moved >> step, held + step
                out |= moved
            bits = out & self.inside
        return bits

    def shrunk(self, bits: int, runs: list[tuple[int, int]], rounds: int = 1) -> int:
        """Erosion; beyond the mask is everything."""
        return self.inside & ~self.spread(self.inside & ~bits, runs, rounds)

    def closed(self, bits: int, runs: list[tuple[int, int]], rounds: int = 1) -> int:
        return self.shrunk(self.spread(bits, runs, rounds), runs, rounds)


def _by_bits(step: str) -> Callable[..., np.ndarray]:
    def run(mask: np.ndarray, kernel: list[tuple[int, int]], rounds: int = 1) -> np.ndarray:
        space = Bits(mask.shape, kernel)
        return space.mask(getattr(space, step)(space.of(mask), space.runs(kernel), rounds))

    return run


# Dilation, erosion and closing of a mask by a kernel of offsets.
spread_by, shrunk_by, closed_by = map(_by_bits, ("spread", "shrunk", "closed"))


def without_specks(mask: np.ndarray, least: int) -> np.ndarray:
    """The 4-connected parts of at least so many cells."""
    y, x = np.nonzero(mask)
    part = parts_of(y, x, diagonal=False)
    keep = np.bincount(part)[part] >= least if len(part) else np.zeros(0, bool)
    out = np.zeros_like(mask)
    out[y[keep], x[keep]] = True
    return out


@dataclass(frozen=True)
class Stopper:
    """Cells of these labels, closed and dilated ``rounds`` times by an elliptical kernel (width, height); as they are with 0."""

    labels: tuple[int, ...]
    kernel: tuple[int, int] = (1, 1)
    rounds: int = 0

    def mask(self, plane: np.ndarray) -> np.ndarray:
        out = _labelled(plane, self.labels)
        if not self.rounds or not out.any():
            return out
        kernel = ellipse(*self.kernel)
        space = Bits(plane.shape, kernel)
        bits, runs = space.of(out), space.runs(kernel)
        for _ in range(self.rounds):
            bits = space.spread(space.closed(bits, runs), runs)
        return space.mask(bits)


@dataclass(frozen=True)
class Growth:
    """How seeds grow: the kernel, the steps of a round in order, closings in one step, the least seed, and the rounds whose masks are wanted."""

    seeds: tuple[int, ...]
    stoppers: tuple[Stopper, ...]
    kernel: tuple[int, int] = (10, 3)
    steps: tuple[str, ...] = ("dilate", "close", "cut")
    closings: int = 1
    least: int = 15
    snapshots: tuple[int, ...] = (2,)


# The labels of text and table regions, their stoppers and kernels.
_SEPARATORS, _UPRIGHT = (6, 8, 10), (9,)
TEXT_BLOCKS = Growth((1, 2, 3, 4), (Stopper((*_SEPARATORS, *_UPRIGHT, 7)), Stopper((5,), (5, 3), 3)), (8, 3), closings=3, snapshots=(3,))
TABLES = Growth((5, 7), (Stopper((*_SEPARATORS, *_UPRIGHT)), Stopper((1, 2, 3, 4), (7, 5), 3)), (10, 3), ("close", "cut", "dilate", "cut"), snapshots=(3, 5))


def _labelled(plane: np.ndarray, labels: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(labels)] = True
    return table[plane]


def seeds_and_free(plane: np.ndarray, how: Growth) -> tuple[np.ndarray, np.ndarray]:
    """The cells to grow from, and those that may be grown into."""
    free = np.ones(plane.shape, bool)
    for s in how.stoppers:
        free &= ~s.mask(plane)
    return without_specks(_labelled(plane, how.seeds), how.least), free


def grown(plane: np.ndarray, how: Growth, begin: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """The masks after the wanted rounds; ``begin`` are the seeds and free cells where they are known."""
    seeds, free = begin or seeds_and_free(plane, how)
    if not seeds.any():
        return [seeds] * len(set(how.snapshots))
    kernel = ellipse(*how.kernel)
    space, out = Bits(plane.shape, kernel), []
    mask, room, runs = space.of(seeds), space.of(free), space.runs(kernel)
    act = {"dilate": lambda m: space.spread(m, runs), "close": lambda m: space.closed(m, runs, how.closings), "cut": lambda m: m & room}
    for i in range(1, max(how.snapshots) + 1):
        for step in how.steps:
            mask = act[step](mask)
        if i in how.snapshots:
            out.append(space.mask(mask))
    return out


def filled_hulls(mask: np.ndarray) -> np.ndarray:
    """Every external region replaced by the cells whose centre its hull holds, borders too; a region of a line or a cell stays."""
    out = mask.copy()
    for b in borders(mask):
        path = turning_cells(b.cells)
        if not b.external or len(path) < 3:
            continue
        ring = hull_of(path)
        low, high = ring.min(0).astype(int), ring.max(0).astype(int)
        ys, xs = np.mgrid[low[1] : high[1] + 1, low[0] : high[0] + 1]
        inside = np.ones(ys.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):  # a hull's corners turn left
            inside &= (bx - ax) * (ys - ay) - (by - ay) * (xs - ax) >= 0
        out[low[1] : high[1] + 1, low[0] : high[0] + 1] |= inside
    return out


def region_growth(planes: DataFrame, how: Growth, hulls: bool = False) -> DataFrame:
    """page, round, height, width and data: the mask (1) of each page's region after each wanted round, as the hulls of its parts if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, mask in zip(sorted(how.snapshots), grown(_array(data, h, w), how), strict=True):
                    rows.append((page, i, h, w, (filled_hulls(mask) if hulls else mask).astype(np.uint8).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["page", "round", "height", "width", "data"])

    return planes.select("page", "height", "width", "data").mapInArrow(run, "page long, round int, height int, width int, data binary")
