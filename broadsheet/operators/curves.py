"""Smoothing splines through separators, their paths across a page, and pages split along them.

A separator's path is seen from its first point along the way to its last one. A spline of degree 2 (1 for under ten points) is
fitted there: the fewest knots with which the squared residuals stay within n + sqrt(2 n), then as smooth as that bound
allows. Paths of one point, and paths that end where they begin, have no direction and cut nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contours import signed_area
from .overlays import RULES, oriented, overlay, within
from .pages import TIE, centroid
from .planes import by_task
from .warps import simplified


def _design(knots: np.ndarray, degree: int, t: np.ndarray) -> np.ndarray:
    """Values of all basis functions; beyond the ends the outer pieces go on."""
    n = len(knots) - degree - 1
    piece = np.clip(np.searchsorted(knots, t, side="right") - 1, degree, n - 1)
    own = np.ones((len(t), 1))
    for d in range(1, degree + 1):
        new = np.zeros((len(t), d + 1))
        for j in range(d):
            low, high = knots[piece + 1 + j - d], knots[piece + 1 + j]
            share = own[:, j] / (high - low)
            new[:, j] += (high - t) * share
            new[:, j + 1] += (t - low) * share
        own = new
    out = np.zeros((len(t), n))
    out[np.arange(len(t))[:, None], piece[:, None] - degree + np.arange(degree + 1)] = own
    return out


@dataclass(frozen=True)
class Spline:
    knots: np.ndarray
    weights: np.ndarray
    degree: int

    def __call__(self, t: np.ndarray) -> np.ndarray:
        return _design(self.knots, self.degree, np.asarray(t, float)) @ self.weights


def _jumps(knots: np.ndarray, degree: int) -> np.ndarray:
    """How much the highest derivative jumps at each inner knot, for each basis function."""
    breaks = np.unique(knots)
    middle = (breaks[1:] + breaks[:-1]) / 2
    step = np.diff(breaks) / 4
    at = [_design(knots, degree, middle + k * step) for k in range(degree + 1)]
    slope = (at[1] - at[0]) / step[:, None] if degree == 1 else (at[2] - 2 * at[1] + at[0]) / step[:, None] ** 2
    return np.diff(slope, axis=0)


def smoothing_spline(x: np.ndarray, y: np.ndarray, degree: int, bound: float) -> Spline:
    """The fewest knots whose least squares stay within the bound, each new one at the median point of the stretch that is furthest off; of these splines the one whose derivative jumps least."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    degree = min(degree, len(np.unique(x)) - 1)
    if degree < 1:
        return Spline(np.array([x[0], x[0] + 1.0]), np.array([y.mean()]), 0)
    inner = np.zeros(0)
    while True:
        knots = np.concatenate(([x.min()] * (degree + 1), inner, [x.max()] * (degree + 1)))
        design = _design(knots, degree, x)
        weights = np.linalg.lstsq(design, y, rcond=None)[0]
        off = (design @ weights - y) ** 2
        breaks = np.concatenate(([x.min()], inner, [x.max()]))
        stretch = np.clip(np.searchsorted(breaks, x, side="right") - 1, 0, len(inner))
        total = np.bincount(stretch, off, minlength=len(inner) + 1)
        choice = [(total[k], -k, np.unique(x[(x > breaks[k]) & (x < breaks[k + 1])])) for k in range(len(inner) + 1)]
        choice = [c for c in choice if len(c[2])]
        if off.sum() <= bound or not choice:
            break
        new = max(choice, key=lambda c: c[:2])[2]
        inner = np.sort(np.append(inner, new[len(new) // 2]))
    if not len(inner) or off.sum() >= bound:
        return Spline(knots, weights, degree)
    jumps, low, high = _jumps(knots, degree), -20.0, 20.0
    scale = np.abs(design).sum() / np.abs(jumps).sum()
    for _ in range(80):  # residuals grow with the weight of the jumps
        weight = (low + high) / 2
        stacked = np.vstack((design, 10.0**weight * scale * jumps))
        tried = np.linalg.lstsq(stacked, np.concatenate((y, np.zeros(len(jumps)))), rcond=None)[0]
        if ((design @ tried - y) ** 2).sum() <= bound:
            low, weights = weight, tried
        else:
            high = weight
    return Spline(knots, weights, degree)


@dataclass(frozen=True)
class Curve:
    """A spline in the frame of a path: its first point, the way to the last one, and the stretch that the path covers."""

    start: np.ndarray
    way: np.ndarray
    spline: Spline
    low: float
    high: float

    def points(self, t: np.ndarray) -> np.ndarray:
        t = np.asarray(t, float)
        return self.start + t[:, None] * self.way + self.spline(t)[:, None] * np.array((-self.way[1], self.way[0]))


def curve_of(path: np.ndarray, tolerance: float = 10.0) -> Curve | None:
    """Of a path without its small bends; none without a direction."""
    path = np.asarray(path, float).reshape(-1, 2)
    if len(path) < 2 or not (path[-1] != path[0]).any():
        return None
    way = (path[-1] - path[0]) / np.hypot(*(path[-1] - path[0]))
    rel = simplified(path, tolerance) - path[0]
    x, y = rel @ way, rel @ np.array((-way[1], way[0]))
    n = len(rel)
    order = np.argsort(x, kind="stable")
    return Curve(path[0], way, smoothing_spline(x[order], y[order], 1 if n < 10 else 2, n + np.sqrt(2 * n)), float(x.min()), float(x.max()))


def longer(path: np.ndarray, share: float) -> np.ndarray:
    """A path along its spline, longer by half the share at both ends; as it is with a share of 1 or without direction."""
    curve = curve_of(path)
    if curve is None or share == 1:
        return np.asarray(path, float)
    more = (curve.high - curve.low) * share / 2
    return curve.points(np.linspace(curve.low - more, curve.high + more, int(np.ceil(len(path) * (1 + share)))))


def cut_path(path: np.ndarray, level: bool, width: float, height: float, points: int = 10) -> np.ndarray | None:
    """A path along its spline from one side of the page to the other, left to right if ``level``, else down the page. None if it doesn't run that way at all."""
    curve = curve_of(path)
    c, size = (0, width) if level else (1, height)
    if curve is None or curve.way[c] == 0:
        return None
    ends = -curve.start[c] / curve.way[c], (size - curve.start[c]) / curve.way[c]
    return curve.points(np.linspace(min(ends), max(ends), points))[:: 1 if curve.way[c] > 0 else -1]


def cut_paths(separators: DataFrame, points: int = 10) -> DataFrame:
    """Separators (page, kind, id, x, y as arrays, width and height of the page) to their paths across the page: page, id, x, y. Those that don't run across give no row.

    A path of two points is its own spline, a straight line, so Spark's expressions make it longer; the others are fitted in tasks of even size.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                path = cut_path(np.stack((r.x, r.y), 1), r.kind == "H", r.width, r.height, points)
                if path is not None:
                    rows.append((r.page, r.id, path[:, 0].tolist(), path[:, 1].tolist()))
            yield pd.DataFrame(rows, columns=["page", "id", "x", "y"])

    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("width") < float("nan")) & (F.col("height") < float("nan"))  # neither null nor NaN, which is the greatest
    known = separators.select("page", F.coalesce("kind", F.lit("")).alias("kind"), "id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")).filter(whole)
    fitted = by_task(known.filter("size(x) > 2")).mapInPandas(run, _PATHS)
    return known.filter("size(x) = 2").transform(_straight_paths, points).unionByName(fitted)


_PATHS = "page long, id long, x array<double>, y array<double>"


def _straight_paths(separators: DataFrame, points: int) -> DataFrame:
    """Paths of two points; along the page every path has the same steps, across it rises evenly."""
    level = F.col("kind") == "H"
    first, last = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, 2))
    along = separators.select("page", "id", level.alias("level"), *[F.when(level, a).otherwise(b).alias(n) for n, a, b in (
        ("from", first("x"), first("y")), ("to", last("x"), last("y")), ("low", first("y"), first("x")), ("high", last("y"), last("x")), ("long", F.col("width"), F.col("height")),
    )]).filter("`from` <> `to`")
    step = lambda i: F.lit(0.0) + i * F.col("long") / float(max(points - 1, 1))
    across = lambda i: F.col("low") + (F.col("high") - F.col("low")) * ((step(i) - F.col("from")) / (F.col("to") - F.col("from")))
    run, beside = (F.array(*[f(i) for i in range(points)]) for f in (step, across))
    return along.select(F.col("page").cast("long"), F.col("id").cast("long"), F.when(F.col("level"), run).otherwise(beside).alias("x"), F.when(F.col("level"), beside).otherwise(run).alias("y"))


def _meets(path: np.ndarray, rings: list[np.ndarray]) -> bool:
    """Whether a path has a point in common with any side of rings."""
    if not rings:
        return False
    c, d = np.concatenate(rings)[None], np.concatenate([np.roll(r, -1, 0) for r in rings])[None]
    a, b = path[:-1, None], path[1:, None]
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    bounds = (np.minimum(a, b) <= np.maximum(c, d)).all(-1) & (np.minimum(c, d) <= np.maximum(a, b)).all(-1)
    return bool((bounds & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)).any())


def length_within(rings: list[np.ndarray], path: np.ndarray) -> float:
    """Length of a path inside rings, holes left out."""
    total = 0.0
    sides = np.concatenate([np.hstack((r, np.roll(r, -1, 0))) for r in rings]) if rings else np.zeros((0, 4))
    for a, b in zip(path[:-1], path[1:], strict=True):
        v, w, rel = b - a, sides[:, 2:] - sides[:, :2], sides[:, :2] - a
        turn = v[0] * w[:, 1] - v[1] * w[:, 0]
        real = turn != 0
        t = (rel[real, 0] * w[real, 1] - rel[real, 1] * w[real, 0]) / turn[real]
        u = (rel[real, 0] * v[1] - rel[real, 1] * v[0]) / turn[real]
        cuts = np.unique(np.concatenate(((0.0, 1.0), t[(t > 0) & (t < 1) & (u >= -1e-9) & (u <= 1 + 1e-9)])))
        middle = a + (cuts[:-1, None] + cuts[1:, None]) / 2 * v
        held = sum((within(r, middle).astype(int) * (1 if signed_area(r) > 0 else -1) for r in rings), np.zeros(len(middle), int)) > 0
        total += float(np.diff(cuts)[held].sum() * np.hypot(*v))
    return total


def beside(path: np.ndarray, level: bool, far: float) -> np.ndarray:
    """The ring of all that lies below a level path, or right of an upright one, up to ``far``; the path goes on straight beyond its ends."""
    add = np.array((far, 0.0)) if level else np.array((0.0, far))
    path = np.vstack((path[0] - add, path, path[-1] + add))
    over = np.array((0.0, 2 * far)) if level else np.array((2 * far, 0.0))
    return oriented(np.vstack((path, path[-1] + over, path[0] + over)))


def split_along(frame: np.ndarray, content: list[np.ndarray], lines: list[tuple[str, int, np.ndarray, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
    """(path, frame) of the leaves in reading order; lines are (label H or V, id, own path, cut path).

    The cut is a separator whose path meets no content of the frame, else any; horizontal ones before vertical ones, then the
    topmost or leftmost by the mean of its own path, then by id. A frame that its cut doesn't divide into two stays whole. Other
    separators go to the part that holds more of their own path, the first one in a tie.
    """
    far = 4 * float(np.abs(frame).max()) + 4 * max((float(np.abs(c).max()) for *_, c in lines), default=0.0) + 1
    todo, leaves = [("", frame, [oriented(r) for r in content if len(r) >= 3], lines)], []
    while todo:
        name, frame, content, lines = todo.pop()
        ranked = sorted(lines, key=lambda s: (_meets(s[3], content), s[0] != "H", s[2].mean(0)[1 if s[0] == "H" else 0], s[1]))
        if not ranked:
            leaves.append((name, frame))
            continue
        label, _, _, cut = ranked[0]
        half = [beside(cut, label == "H", far)]
        parts = [overlay([oriented(frame)], half, RULES[how]) for how in ("difference", "intersection")]
        if any(len(p) != 1 for p in parts):
            leaves.append((name, frame))
            continue
        held = [overlay(content, half, RULES[how]) for how in ("difference", "intersection")]
        both = sorted(zip((p[0] for p in parts), held, strict=True), key=lambda p: centroid(p[0])[1 if label == "H" else 0])
        second = [length_within([both[1][0]], s[2]) > length_within([both[0][0]], s[2]) + TIE for s in ranked[1:]]
        todo += [(f"{name}/{k}", *both[k], [s for s, late in zip(ranked[1:], second, strict=True) if late == bool(k)]) for k in (1, 0)]
    return leaves


def split_pages_along(pages: DataFrame, content: DataFrame, separators: DataFrame) -> DataFrame:
    """Pages (page, width, height) to their frames in reading order: page, leaf, path, x, y.

    Content are polygons (page, x, y as arrays), separators paths (page, kind H or V, id, x, y as arrays). A page without separators is one frame;
    content and separators of other pages, and such with null coordinates, are left out.
    """
    names = ["page", "leaf", "path", "x", "y"]
    ring = F.struct("x", "y")
    size = pages.groupBy("page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    marks = content.select("page", F.lit("C").alias("kind"), F.lit(0).cast("long").alias("id"), ring.alias("path")).unionByName(separators.filter("kind in ('H', 'V')").select("page", "kind", F.col("id").cast("long").alias("id"), ring.alias("path")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or left[["width", "height"]].isna().any(axis=None):
            return pd.DataFrame(columns=names)
        page, w, h = left.iloc[0][["page", "width", "height"]]
        rows = [(r.kind, r.id, np.stack((r.path["x"], r.path["y"]), 1).astype(float)) for r in right.itertuples() if r.path["x"] is not None and r.path["y"] is not None and len(r.path["x"])] if len(right) else []
        lines = [(kind, i, p, cut_path(p, kind == "H", w, h)) for kind, i, p in rows if kind != "C"]
        box = np.array([(0, 0), (w, 0), (w, h), (0, h)], float)
        leaves = split_along(box, [p for kind, _, p in rows if kind == "C"], [s for s in lines if s[3] is not None])
        return pd.DataFrame([(page, i + 1, name, r[:, 0].tolist(), r[:, 1].tolist()) for i, (name, r) in enumerate(leaves)], columns=names)

    return by_task(size).groupBy("page").cogroup(by_task(marks).groupBy("page")).applyInPandas(run, "page long, leaf long, path string, x array<double>, y array<double>")
