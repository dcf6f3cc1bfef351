"""Text and table polygons of a page: grown regions as hulls, parted about the upright separator that stands in one.

A part of a strongly grown region gives the hull of its weakly grown cells. Where the centre of an upright separator lies well
inside that hull, the region reaches around the separator's head; then the smaller pieces are put together above,
left and right of it. Hulls that meet are merged. Separators are paths (page, id, x, y as arrays); of several in one hull the
first by id counts. Planes without text give no rows; separators of pages without a plane are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contours import polygons_of, signed_area
from .geometry import area_of, hull_of, merged_hulls_of, parts_of
from .growth import TABLES, TEXT_BLOCKS, Growth, Stopper, ellipse, grown, spread_by, without_specks
from .overlays import RING_NAMES, RING_SCHEMA, RING_TYPES, RULES, oriented, overlay, polygons
from .pages import centroid, clipped
from .planes import _array, by_task

SIDES = ("top", "left", "right")


@dataclass(frozen=True)
class Blocks:
    """How regions become polygons. Labels, kernels, margins and areas."""

    text: tuple[int, ...] = (1, 2, 3, 4)
    illustration: int = 11
    table: int = 5
    pieces: tuple[int, int] = (8, 2)
    kernel: tuple[int, int] = (8, 3)
    table_kernel: tuple[int, int] = (6, 5)
    ground: tuple[int, int] = (5, 3)
    table_ground: Stopper = Stopper((1, 2, 3, 4), (7, 3), 1)
    margin: float = 5.0
    shrink: float = 2.0
    least: float = 100.0
    speck: int = 15


def path_centre(path: np.ndarray) -> np.ndarray:
    """Of a path by length; of one point the point."""
    step = np.hypot(*np.diff(path, axis=0).T)
    return ((path[1:] + path[:-1]) / 2 * step[:, None]).sum(0) / step.sum() if step.sum() else path[0]


def depth(ring: np.ndarray, point: np.ndarray) -> float:
    """How far a point lies from the nearest side of a hull, negative outside; hulls turn left."""
    way = np.roll(ring, -1, 0) - ring
    rel = np.asarray(point, float) - ring
    return float(((way[:, 0] * rel[:, 1] - way[:, 1] * rel[:, 0]) / np.hypot(*way.T)).min()) if len(ring) >= 3 else -np.inf


def shrunk(ring: np.ndarray, by: float) -> np.ndarray:
    """A hull without what lies nearer to its border; empty if nothing is left."""
    out = ring
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        v = (b - a) / np.hypot(*(b - a))
        out = clipped(out, v[0] * (out[:, 1] - a[1]) - v[1] * (out[:, 0] - a[0]) - by)
        if len(out) < 3:
            return np.zeros((0, 2))
    return out if area_of(out) > 0 else np.zeros((0, 2))


def side_of(centre: np.ndarray, path: np.ndarray) -> str:
    """Above a separator's head, else left or right of its median."""
    if centre[1] < path[:, 1].min():
        return "top"
    return "left" if centre[0] < np.median(path[:, 0]) else "right"


def hull_groups(rings: list[np.ndarray], path: np.ndarray) -> list[np.ndarray]:
    """One hull for each side of a separator that holds rings, by their centres of area."""
    sides = [side_of(centroid(r), path) for r in rings]
    return [hull_of(np.concatenate([r for r, s in zip(rings, sides, strict=True) if s == side])) for side in SIDES if side in sides]


def _parts(mask: np.ndarray) -> list[tuple[tuple[slice, slice], np.ndarray]]:
    """The 8-connected parts, each as its bounds and its cells within them."""
    y, x = np.nonzero(mask)
    part = parts_of(y, x)
    out = []
    for cells in np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=1)[1:])[:-1]) if len(y) else ():
        py, px = y[cells], x[cells]
        one = np.zeros((np.ptp(py) + 1, np.ptp(px) + 1), bool)
        one[py - py.min(), px - px.min()] = True
        out.append(((slice(py.min(), py.max() + 1), slice(px.min(), px.max() + 1)), one))
    return out


def _rings(at: tuple[slice, slice], mask: np.ndarray, hulls: bool, least: float) -> list[np.ndarray]:
    return [r + (at[1].start, at[0].start) for r in polygons_of(mask, hulls, least, tolerance=None)] if mask.any() else []


def _parting(hull: np.ndarray, separators: list[np.ndarray], how: Blocks) -> np.ndarray | None:
    return next((s for s in separators if depth(hull, path_centre(s)) > how.margin), None)


def _outline(at: tuple[slice, slice], mask: np.ndarray, how: Blocks) -> np.ndarray | None:
    rings = _rings(at, mask, False, how.least)
    return hull_of(np.concatenate(rings)) if rings else None


def _merged(hulls: list[np.ndarray]) -> list[np.ndarray]:
    return [h for _, h in merged_hulls_of(hulls)] if hulls else []


def text_hulls(plane: np.ndarray, label: int, free: np.ndarray, separators: list[np.ndarray], how: Blocks) -> tuple[list[np.ndarray], np.ndarray]:
    """The hulls of one label, shrunk, and its strongly grown region outside other content. Where text may grow (``free``) is the same for all labels."""
    weak = Growth((label,), TEXT_BLOCKS.stoppers, how.kernel, least=how.speck, snapshots=(1,))
    begin = without_specks(plane == label, how.speck), free
    if not begin[0].any():
        return [], begin[0]
    others = [x for x in how.text if x != label]
    ground = spread_by(np.isin(plane, (how.illustration, how.table, *others)), ellipse(*how.ground))
    ((pieces,), (micro,)) = (grown(plane, replace(weak, kernel=k), begin) for k in (how.pieces, how.kernel))
    macro = grown(plane, replace(weak, closings=3, snapshots=(3,)), begin)[0] & ~ground
    hulls = []
    for at, part in _parts(macro):
        hull = _outline(at, part & micro[at], how)
        if hull is None:
            continue
        parting = _parting(hull, separators, how)
        hulls += [hull] if parting is None else hull_groups(_rings(at, part & pieces[at], True, how.least), parting)
    return [s for s in (shrunk(h, how.shrink) for h in _merged(hulls)) if len(s)], macro


def text_polygons_of(plane: np.ndarray, separators: list[np.ndarray], how: Blocks = Blocks()) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Outer rings and holes of the text, less illustrations outside the grown region of the last label. Of several polygons those of enough area stay."""
    texts, macro = [], np.zeros(plane.shape, bool)
    free = ~np.logical_or.reduce([stopper.mask(plane) for stopper in TEXT_BLOCKS.stoppers])
    for label in how.text:
        hulls, macro = text_hulls(plane, label, free, separators, how)
        texts += hulls
    pictures = polygons_of(spread_by(plane == how.illustration, ellipse(*how.ground)) & ~macro)
    made = polygons(overlay([oriented(r) for r in texts], [oriented(r) for r in pictures], RULES["difference"]))
    size = lambda p: signed_area(p[0]) + sum(map(signed_area, p[1]))
    return made if len(made) == 1 else [p for p in made if size(p) > how.least]


def table_polygons_of(plane: np.ndarray, separators: list[np.ndarray], how: Blocks = Blocks()) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Hulls of the tables; one that a separator parts gives the hulls of its pieces. They have no holes."""
    stages = grown(plane, replace(TABLES, kernel=how.table_kernel, least=how.speck, snapshots=(2, 5)))
    micro, macro = (_filled(polygons_of(m, least=how.least), plane.shape) for m in stages)
    free = ~how.table_ground.mask(plane)
    hulls = []
    for at, part in _parts(macro):
        added = part & micro[at]
        if not added.any():
            continue
        y, x = np.nonzero(added)
        hull = _outline(at, _filled([hull_of(np.stack((x, y), 1))], part.shape) & free[at], how)
        if hull is None:
            continue
        parting = _parting(hull, separators, how)
        hulls += [hull] if parting is None else _rings(at, added & free[at], True, 0.0)
    return [(h, []) for h in _merged(hulls)]


def _filled(hulls: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The cells whose centre lies in a hull or on its border."""
    out = np.zeros(shape, bool)
    for ring in hulls:
        low, high = np.floor(ring.min(0)).astype(int), np.ceil(ring.max(0)).astype(int)
        ys, xs = np.mgrid[low[1] : high[1] + 1, low[0] : high[0] + 1]
        inside = np.ones(ys.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
            inside &= (bx - ax) * (ys - ay) - (by - ay) * (xs - ax) >= -1e-9
        out[low[1] : high[1] + 1, low[0] : high[0] + 1] |= inside
    return out


def _by_page(planes: DataFrame, separators: DataFrame, kernel: Callable) -> DataFrame:
    """Every plane with its page's separators, which are one list, through a kernel that gives polygons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, h, w, data, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                paths = [np.array((s["x"], s["y"]), float).T for s in sorted(held or (), key=lambda s: s["id"]) if s["x"]]
                for i, (outer, holes) in enumerate(kernel(_array(data, h, w), paths)):
                    rows += [(page, i, k, k > 0, r[:, 0], r[:, 1], signed_area(r)) for k, r in enumerate((outer, *holes))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RING_TYPES, strict=True)], RING_NAMES)

    own = by_task(separators.select("page", "id", "x", "y")).groupBy("page").agg(F.collect_list(F.struct("id", "x", "y")).alias("own"))
    return by_task(planes.select("page", "height", "width", "data")).join(own, "page", "left").mapInArrow(run, RING_SCHEMA)


def text_polygons(planes: DataFrame, separators: DataFrame, how: Blocks = Blocks()) -> DataFrame:
    """page, id, ring, hole, x, y and area of the text of each plane (page, height, width, data)."""
    return _by_page(planes, separators, lambda plane, paths: text_polygons_of(plane, paths, how))


def table_polygons(planes: DataFrame, separators: DataFrame, how: Blocks = Blocks()) -> DataFrame:
    """The same of its tables."""
    return _by_page(planes, separators, lambda plane, paths: table_polygons_of(plane, paths, how))


def separator_sides(centres: DataFrame, separators: DataFrame) -> DataFrame:
    """Centres (page, block, id, x, y) and the separator of their block (page, block, x, y as arrays, one row a block) to page, block, id and side; the left side begins at the median of the separator's points."""
    s = separators.select("page", "block", F.array_min("y").alias("head"), F.array_sort("x").alias("xs"))
    n = F.size("xs")
    middle = (F.element_at("xs", ((n + 1) / 2).cast("int")) + F.element_at("xs", (n / 2).cast("int") + 1)) / 2
    side = F.when(F.col("y") < F.col("head"), "top").when(F.col("x") < F.col("middle"), "left").otherwise("right")
    return centres.select("page", "block", "id", "x", "y").join(s.filter(n > 0).select("page", "block", "head", middle.alias("middle")), ["page", "block"]).select("page", "block", "id", side.alias("side"))
