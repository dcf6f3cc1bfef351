"""Polygons cut by lines: a simple polygon, convex or not, falls into as many pieces as the line makes.

Corners on a line count as lying on its left, so every crossing is one of a side with the line. Sorted along the line,
crossings pair up: between the first and the second of a pair the line runs inside. Pieces without area go. Polygons that
no line meets stay whole; polygons of under three corners and lines of one point cut nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

_FLAT = 1e-9
_NAMES = ["page", "id", "piece", "x", "y", "area"]
_PIECES = "page long, id long, piece int, x array<double>, y array<double>, area double"


def cut(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The pieces of a ring on both sides of the line through a and b, in the order of their first corner."""
    (ax, ay), (bx, by) = np.asarray(a, float).tolist(), np.asarray(b, float).tolist()
    return [np.array(p, float) for p in _cut(np.asarray(ring, float).tolist(), ax, ay, bx - ax, by - ay)]


def _cut(ring: list, ax: float, ay: float, vx: float, vy: float) -> list[list]:
    """``cut`` on lists of corners: rings are short, so an array's fixed cost a step would be most of the time."""
    n = len(ring)
    if n < 3 or not (vx or vy):
        return [ring]
    across = [vx * (y - ay) - vy * (x - ax) for x, y in ring]
    if min(across) >= 0 or max(across) < 0:
        return [ring]
    place, points, along = {}, [], []
    for i, here in enumerate(across):
        there = across[i + 1 - n]
        if (here >= 0) != (there >= 0):
            share = here / (here - there)
            (x, y), (to_x, to_y) = ring[i], ring[i + 1 - n]
            x, y = x + share * (to_x - x), y + share * (to_y - y)
            place[i] = len(points)
            points.append([x, y])
            along.append((x - ax) * vx + (y - ay) * vy)
    crossed = list(place)
    order = sorted(range(len(points)), key=along.__getitem__)
    partner = [0] * len(order)
    for k, m in zip(order[::2], order[1::2], strict=True):
        partner[k], partner[m] = m, k
    seen, pieces = bytearray(n), []
    for first in range(n):
        if seen[first]:
            continue
        piece, i = [], first
        while not seen[i]:
            seen[i] = 1
            piece.append(ring[i])
            if i in place:  # leave along the line and come back where its other crossing does
                k = partner[place[i]]
                piece += [points[place[i]], points[k]]
                i = crossed[k]
            i = (i + 1) % n
        piece = [p for k, p in enumerate(piece) if abs(p[0] - piece[k - 1][0]) > _FLAT or abs(p[1] - piece[k - 1][1]) > _FLAT]
        if _area(piece) > _FLAT:
            pieces.append(piece)
    return pieces


def _area(ring: list) -> float:
    return abs(sum(ring[k - 1][0] * y - ring[k - 1][1] * x for k, (x, y) in enumerate(ring))) / 2 if len(ring) >= 3 else 0.0


def _lined(ring: list, lines: list) -> list[list]:
    """The pieces of a ring after every line (x0, y0, x1, y1), one after the other, in the order across the lines' mean direction, then along it."""
    pieces = [ring]
    for x0, y0, x1, y1 in lines:
        pieces = [q for p in pieces for q in _cut(p, x0, y0, x1 - x0, y1 - y0)]
    vx, vy = (sum(s[2] - s[0] for s in lines), sum(s[3] - s[1] for s in lines)) if lines else (1.0, 0.0)
    long = np.hypot(vx, vy) or 1.0
    vx, vy = float(vx / long), float(vy / long)
    middle = []
    for p in pieces:
        xs, ys = [c[0] for c in p], [c[1] for c in p]
        x, y = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2
        middle.append((round(vx * y - vy * x, 6), round(vx * x + vy * y, 6)))
    return [pieces[i] for i in sorted(range(len(pieces)), key=middle.__getitem__)] if len(pieces) > 1 else pieces


def lined_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (page, id, x, y as arrays) cut by their own baselines (lines: an array of x0, y0, x1, y1): page, id, piece from 0 down the page, x, y and area. No block meets another, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of, xs, ys, area = [], [], [], [], []
            for k, (x, y, lines) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                for n, p in enumerate(_lined([*zip(x, y, strict=True)], [(s["x0"], s["y0"], s["x1"], s["y1"]) for s in lines])):
                    at.append(k)
                    of.append(n)
                    xs.append([c[0] for c in p])
                    ys.append([c[1] for c in p])
                    area.append(_area(p))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(of, pa.int32()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.float64())), pa.array(area, pa.float64())], _NAMES)

    return blocks.select("page", "id", "x", "y", "lines").mapInArrow(run, _PIECES)


def block_lines(blocks: DataFrame, baselines: DataFrame) -> DataFrame:
    """Blocks (page, id, x, y as arrays) cut by the baselines (page, block, line, x0, y0, x1, y1) that belong to them: page, id, piece from 0 down the page, x, y and area. A block without baselines is one piece."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        own = {k: g.sort_values("line")[["x0", "y0", "x1", "y1"]].to_numpy(float).tolist() for k, g in right.groupby("block")}
        for r in left.itertuples():
            for n, p in enumerate(_lined(np.stack((r.x, r.y), 1).astype(float).tolist(), own.get(r.id, []))):
                rows.append((r.page, r.id, n, [c[0] for c in p], [c[1] for c in p], _area(p)))
        return pd.DataFrame(rows, columns=_NAMES)

    return blocks.groupBy("page").cogroup(baselines.groupBy("page")).applyInPandas(run, _PIECES)
