"""Union, difference and intersection of polygons by one overlay of all their sides, page by page.

A region is a list of rings whose outer ones run with positive and whose holes run with negative area; a point belongs
to it if the rings wind around it more often than not at all. So rings of one region may overlap, meet along sides or lie
in each other. Sides are cut where they meet, equal pieces are taken together, and a piece is a border of the result
where just one of its two sides belongs. Coordinates are rounded to 2^-20. Rings of under three corners
or without area hold nothing; a page without polygons gives none; null coordinates make a ring empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contours import signed_area
from .planes import by_task

_GRID = 2.0**20
_NEAR = 2.0**-18
_RAYS = 64  # rays that are tested at once
_TABLE = 1 << 20  # cells of one table of points against sides

Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]
RULES: dict[str, Rule] = {"union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "either": lambda a, b: a ^ b}


def oriented(ring: np.ndarray, hole: bool = False) -> np.ndarray:
    """A ring in the direction of an outer one, or of a hole."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    return ring[::-1] if len(ring) >= 3 and (signed_area(ring) < 0) != hole else ring


def _sides(rings: list[np.ndarray]) -> np.ndarray:
    """Sides as (x0, y0, x1, y1)."""
    made = [r for r in rings if len(r) >= 3]
    if not made:
        return np.zeros((0, 4))
    points = np.round(np.concatenate(made).astype(float) * _GRID) / _GRID
    end = np.cumsum([len(r) for r in made])
    ahead = np.arange(1, len(points) + 1)
    ahead[end - 1] = np.append(0, end[:-1])
    sides = np.hstack((points, points[ahead]))
    return sides[(sides[:, :2] != sides[:, 2:]).any(1)]


def _meeting(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sides whose bounds meet, by a sweep over x."""
    low, high = np.minimum(sides[:, :2], sides[:, 2:]) - _NEAR, np.maximum(sides[:, :2], sides[:, 2:]) + _NEAR
    order = np.argsort(low[:, 0], kind="stable")
    last = np.searchsorted(low[order, 0], high[order, 0], side="right")
    count = last - np.arange(len(order)) - 1
    i = np.repeat(np.arange(len(order)), count)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    i, j = order[i], order[j]
    keep = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
    return i[keep], j[keep]


def _split_once(sides: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sides cut at crossings and at ends of others that lie on them, and whether more may have to be cut: not if no side was, or if all cut ones run along an axis and were cut on their line, so that none has moved."""
    i, j = _meeting(sides)
    a, v, b, w = sides[i, :2], sides[i, 2:] - sides[i, :2], sides[j, :2], sides[j, 2:] - sides[j, :2]
    turn = v[:, 0] * w[:, 1] - v[:, 1] * w[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((b[:, 0] - a[:, 0]) * w[:, 1] - (b[:, 1] - a[:, 1]) * w[:, 0]) / turn
        u = ((b[:, 0] - a[:, 0]) * v[:, 1] - (b[:, 1] - a[:, 1]) * v[:, 0]) / turn
    met = (turn != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    cross = np.round((a[met] + t[met, None] * v[met]) * _GRID) / _GRID
    owner, point = [i[met], j[met]], [cross, cross]
    for s, o in ((i, j), (j, i)):
        way = sides[s, 2:] - sides[s, :2]
        long = np.hypot(*way.T)
        for end in (sides[o, :2], sides[o, 2:]):
            rel = end - sides[s, :2]
            on = (np.abs(way[:, 0] * rel[:, 1] - way[:, 1] * rel[:, 0]) <= _NEAR * long) & ((rel * way).sum(1) > 0) & ((rel * way).sum(1) < long**2)
            owner.append(s[on])
            point.append(end[on])
    owner, point = np.concatenate(owner), np.concatenate(point)
    inner = (point != sides[owner, :2]).any(1) & (point != sides[owner, 2:]).any(1)
    owner, point = owner[inner], point[inner]
    if not len(owner):
        return sides, group, False
    own_side = sides[owner]
    still = ((own_side[:, :2] == own_side[:, 2:]) & (point == own_side[:, :2])).any(1)
    everyone = np.arange(len(sides))
    owner, point = np.concatenate((everyone, owner, everyone)), np.concatenate((sides[:, :2], point, sides[:, 2:]))
    along = ((point - sides[owner, :2]) * (sides[owner, 2:] - sides[owner, :2])).sum(1)
    along[: len(sides)], along[-len(sides) :] = -np.inf, np.inf
    order = np.lexsort((along, owner))
    owner, point = owner[order], point[order]
    same = owner[1:] == owner[:-1]
    pieces = np.hstack((point[:-1], point[1:]))[same]
    own = group[owner[:-1][same]]
    real = (pieces[:, :2] != pieces[:, 2:]).any(1)
    return pieces[real], own[real], not still.all()


def _pieces(first: list[np.ndarray], second: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces from the lesser to the greater end, each once, and how often each region runs along it, less against it."""
    parts = [_sides(first), _sides(second)]
    sides, group, more = np.concatenate(parts), np.repeat((0, 1), [len(p) for p in parts]), True
    for _ in range(30):  # a rounded crossing may bring a side onto another; this ends after two or three
        if not more:
            break
        sides, group, more = _split_once(sides, group)
    back = (sides[:, 0] > sides[:, 2]) | ((sides[:, 0] == sides[:, 2]) & (sides[:, 1] > sides[:, 3]))
    sides = np.where(back[:, None], sides[:, [2, 3, 0, 1]], sides)
    unique, at = np.unique(sides, axis=0, return_inverse=True)
    net = np.zeros((len(unique), 2), int)
    np.add.at(net, (at.ravel(), group), np.where(back, -1, 1))
    used = net.any(1)
    return unique[used], net[used]


def _windings(sides: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often both regions wind around the points just left and just right of each piece's middle."""
    x0, y0, x1, y1 = sides.T
    flat = np.abs(x1 - x0) >= np.abs(y1 - y0)
    left, right = np.zeros_like(net), np.zeros_like(net)
    mid = (sides[:, :2] + sides[:, 2:]) / 2
    # flat pieces look up along y, steep ones along x: what lies beyond a piece's middle and runs across the ray
    for chosen, c in ((flat, 0), (~flat, 1)):
        p, q, d = sides[:, c], sides[:, 2 + c], 1 - c
        crossing = np.flatnonzero(p != q)
        low, high, sign = np.minimum(p, q)[crossing], np.maximum(p, q)[crossing], np.sign(q - p)[crossing]
        slope = (sides[crossing, 2 + d] - sides[crossing, d]) / (q - p)[crossing]
        rows = np.flatnonzero(chosen)
        rows = rows[np.argsort(mid[rows, c], kind="stable")]  # neighbours' rays meet the same few sides
        for part in np.array_split(rows, max(1, -(-len(rows) // _RAYS))):
            m = mid[part]
            reached = (low <= m[-1, c]) & (m[0, c] < high) if len(part) else np.zeros(len(low), bool)
            across, lows, highs, up = crossing[reached], low[reached], high[reached], sign[reached]
            spans = (lows <= m[:, c : c + 1]) & (m[:, c : c + 1] < highs)
            beyond = spans & (sides[across, d] + slope[reached] * (m[:, c : c + 1] - p[across]) > m[:, d : d + 1]) & (across != part[:, None])
            count = beyond.astype(float) @ (up[:, None] * net[across])
            if c == 0:  # a piece to greater x has greater y on its left
                left[part] = -np.rint(count).astype(int)
                right[part] = left[part] - net[part]
            else:
                own = np.sign(sides[part, 3] - sides[part, 1])[:, None].astype(int)
                near, far = np.rint(count).astype(int), np.rint(count).astype(int) + own * net[part]  # at greater x, at lesser x
                left[part], right[part] = np.where(own > 0, far, near), np.where(own > 0, near, far)
    return left, right


def _walked(sides: np.ndarray) -> list[np.ndarray]:
    """Directed pieces put together to rings that have the region on their left and touch no corner twice."""
    corners, at = np.unique(np.concatenate((sides[:, :2], sides[:, 2:])), axis=0, return_inverse=True)
    start, end = np.split(at.ravel(), 2)
    angle = np.arctan2(sides[:, 3] - sides[:, 1], sides[:, 2] - sides[:, 0])
    leaving: dict[int, list[int]] = {}
    for k, s in enumerate(start.tolist()):
        leaving.setdefault(s, []).append(k)
    free, rings = np.ones(len(sides), bool), []
    for first in range(len(sides)):
        if not free[first]:
            continue
        path, place, k = [int(start[first])], {int(start[first]): 0}, first
        while True:
            free[k] = False
            corner = int(end[k])
            if corner in place:  # what was walked since then is a ring of its own
                rings.append(corners[path[place[corner] :]])
                for c in path[place[corner] + 1 :]:
                    del place[c]
                path = path[: place[corner] + 1]
            else:
                place[corner] = len(path)
                path.append(corner)
            ahead = [n for n in leaving.get(corner, ()) if free[n]]
            if not ahead:
                break
            k = max(ahead, key=lambda n: (angle[n] - angle[k] + np.pi) % (2 * np.pi))  # the sharpest turn to the left
    return rings


def _without_flat_corners(ring: np.ndarray) -> np.ndarray:
    after = np.concatenate((ring[1:], ring[:1])) - ring
    before = np.concatenate((after[-1:], after[:-1]))
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
    kept = ring[bend > _NEAR * np.hypot(*(before + after).T)]
    return kept if len(kept) >= 3 else ring


def overlay(first: list[np.ndarray], second: list[np.ndarray], rule: Rule) -> list[np.ndarray]:
    """The rings of the points that the rule keeps, given whether they are in the first and in the second region; never those in neither."""
    sides, net = _pieces(first, second)
    if not len(sides):
        return []
    left, right = (rule(w[:, 0] > 0, w[:, 1] > 0) for w in _windings(sides, net))
    border = left != right
    sides = np.where(left[:, None], sides, sides[:, [2, 3, 0, 1]])[border]
    rings = [_without_flat_corners(r) for r in _walked(sides)] if len(sides) else []
    return [r for r in rings if len(r) >= 3 and abs(signed_area(r)) > _NEAR]


def united(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The union of outer rings."""
    return overlay([oriented(r) for r in rings], [], RULES["union"])


def within(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which points a ring holds."""
    px, py = np.asarray(points, float).reshape(-1, 2).T
    ring = np.asarray(ring, float).reshape(-1, 2)
    inside = np.zeros(len(px), bool)
    for part in np.array_split(np.arange(len(px)), max(1, -(-len(px) * len(ring) // _TABLE))):
        (ax, ay), (bx, by) = ring.T, np.concatenate((ring[1:], ring[:1])).T
        met = (ay > py[part, None]) != (by > py[part, None])
        k, side = np.nonzero(met)
        x = (bx - ax)[side] * (py[part][k] - ay[side]) / (by - ay)[side] + ax[side]
        inside[part] = np.bincount(k, px[part][k] < x, len(part)) % 2 == 1
    return inside


def polygons(rings: list[np.ndarray]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """The rings of a result as outer rings, each with its holes; the outer ones by their least corner."""
    areas = [signed_area(r) for r in rings]
    outer = sorted((k for k, a in enumerate(areas) if a > 0), key=lambda k: (*min(map(tuple, rings[k].tolist())), areas[k]))
    size = np.array([areas[k] for k in outer])
    outer = [rings[k] for k in outer]
    bounds = np.array([[*r.min(0), *r.max(0)] for r in outer]).reshape(-1, 4)
    holes: list[list[np.ndarray]] = [[] for _ in outer]
    for hole in (r for r, a in zip(rings, areas, strict=True) if a < 0):
        low, high = hole.min(0), hole.max(0)
        about = np.flatnonzero((bounds[:, :2] <= high).all(1) & (bounds[:, 2:] >= low).all(1))
        middle = (hole + np.concatenate((hole[1:], hole[:1]))) / 2  # corners may touch the outer ring, the middles of sides don't
        for k in about[np.argsort(size[about], kind="stable")].tolist():  # the smallest that holds it
            if within(outer[k], middle).mean() > 0.5:
                holes[k].append(hole)
                break
    return list(zip(outer, holes, strict=True))


def _region(rings: Iterable[tuple]) -> list[np.ndarray]:
    """Rings (x, y, hole) in their direction; such with nulls or without a place hold nothing."""
    out = []
    for x, y, hole in rings:
        if x is not None and y is not None and len(x) >= 3:
            ring = np.array((x, y), float).T
            if np.isfinite(ring).all():
                out.append(oriented(ring, bool(hole)))
    return out


def overlaid(left: DataFrame, right: DataFrame, how: str = "union") -> DataFrame:
    """Polygons (page, x, y as arrays, perhaps hole) of both sides by page: their ``union``, ``intersection``, ``difference`` or what ``either`` holds alone.

    Rows of one side may overlap. Gives page, id of the polygon, ring (0 for the outer one), hole, x, y and area (negative for holes),
    in the form that this function takes. Both sides are shuffled as one table.
    """
    rule = RULES[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                side, x, y, hole = (c.to_pylist() for c in held.values.flatten())
                regions = [_region((a, b, h) for s, a, b, h in zip(side, x, y, hole, strict=True) if s == k) for k in (0, 1)]
                for i, (outer, holes) in enumerate(polygons(overlay(*regions, rule))):
                    rows += [(page, i, k, k > 0, r[:, 0], r[:, 1], signed_area(r)) for k, r in enumerate((outer, *holes))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RING_TYPES, strict=True)], RING_NAMES)

    place = lambda c: F.col(c).cast("array<double>").alias(c)
    own = [s.select(F.col("page").cast("long").alias("page"), F.struct(F.lit(k).alias("side"), place("x"), place("y"), (F.coalesce("hole", F.lit(False)) if "hole" in s.columns else F.lit(False)).alias("hole")).alias("own")) for k, s in enumerate((left, right))]
    return by_task(own[0].unionByName(own[1])).groupBy("page").agg(F.collect_list("own").alias("own")).mapInArrow(run, RING_SCHEMA)


RING_SCHEMA = "page long, id long, ring int, hole boolean, x array<double>, y array<double>, area double"
RING_NAMES = ["page", "id", "ring", "hole", "x", "y", "area"]
RING_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
