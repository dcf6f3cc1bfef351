"""Per-page geometry in numpy, applied page by page with Arrow.

A page is a bounded unit (one scanned sheet), so a group never grows with the corpus; only
``convex_hulls`` takes pages of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .warps import smoothed_at


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost lowest point."""
    pts = np.asarray(points, float).reshape(-1, 2)
    pts = pts[np.lexsort((pts[:, 1], pts[:, 0]))]
    pts = pts[np.append(True, (pts[1:] != pts[:-1]).any(1))] if len(pts) else pts
    if len(pts) < 3:
        return pts
    new = pts[1:, 0] != pts[:-1, 0]
    outer = pts[np.append(True, new) | np.append(new, True)].tolist()  # of equal x the lowest and the highest

    def chain(order: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(outer) + chain(outer[::-1]))


def area_of(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def outer_points(points: np.ndarray) -> np.ndarray:
    """The points but for those well inside the hull, which no further point can make a corner; one that lies on a side but for rounding stays."""
    pts = np.unique(points, axis=0)
    ring = hull_of(pts)
    if len(ring) < 3:
        return pts
    side = np.roll(ring, -1, 0) - ring
    least = np.full(len(pts), np.inf)
    for (x, y), (dx, dy) in zip(ring, side, strict=True):
        least = np.minimum(least, (dx * (pts[:, 1] - y) - dy * (pts[:, 0] - x)) / np.hypot(dx, dy))
    return pts[~(least > 1e-9 * np.abs(ring).max())]


def convex_hulls(points: DataFrame) -> DataFrame:
    """(page, x, y) to the hull's corners in order, and its area. Each task reduces its share of a page to the points that can be corners; only these meet."""

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for page, part in pdf.groupby("page", dropna=False):
                page = None if pd.isna(page) else int(page)
                pts = part[["x", "y"]].to_numpy(float)
                held[page] = outer_points(np.concatenate((held[page], pts)) if page in held else pts)
        for page, pts in held.items():
            yield pd.DataFrame({"page": pd.array([page] * len(pts), "Int64"), "x": pts[:, 0], "y": pts[:, 1]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull_of(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"page": pdf["page"].iloc[0], "corner": np.arange(len(ring)), "x": ring[:, 0], "y": ring[:, 1], "area": area_of(ring)})

    few = points.select("page", "x", "y").mapInPandas(outer, "page long, x double, y double")
    return few.groupBy("page").applyInPandas(run, "page long, corner long, x double, y double, area double")


def parts_of(y: np.ndarray, x: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Number of the 8-connected component of each cell (4-connected if not ``diagonal``), in the order of the cells' least (y, x).

    Cells are one sorted array and fall into runs along x; runs that touch in the next line are found by search, and labels fall to the least of each
    component by neighbours' labels and then labels' own labels.
    """
    if not len(y):
        return np.zeros(0, int)
    wide = int(x.max()) - int(x.min()) + 3
    key = (y.astype(np.int64) - int(y.min())) * wide + (x.astype(np.int64) - int(x.min()) + 1)
    cells, back = (key, slice(None)) if (key[1:] > key[:-1]).all() else np.unique(key, return_inverse=True)
    breaks = np.flatnonzero(np.diff(cells) > 1) + 1
    start, end = cells[np.append(0, breaks)], cells[np.append(breaks - 1, len(cells) - 1)]
    beside = 1 if diagonal else 0
    first, last = np.searchsorted(end, start + wide - beside), np.searchsorted(start, end + wide + beside, "right")
    met = last - first
    one = np.repeat(np.arange(len(start)), met)
    two = np.arange(len(one)) - np.repeat(np.cumsum(met) - met - first, met)
    label = np.arange(len(start))
    while True:
        least = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, label[one], least)
        np.minimum.at(new, label[two], least)
        new = new[new]
        if (new == label).all():
            number = np.cumsum(label == np.arange(len(label)))[label]
            return np.repeat(number, np.diff(np.concatenate(([0], breaks, [len(cells)]))))[back]
        label = new


def components(cells: DataFrame, min_cells: int = 1) -> DataFrame:
    """(page, y, x, label) to one row a component: number, label, cells and bounds; smaller ones go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, part in pdf.groupby("label"):
            numbered = part.assign(component=parts_of(part["y"].to_numpy(), part["x"].to_numpy()))
            g = numbered.groupby("component").agg(n=("x", "size"), miny=("y", "min"), maxy=("y", "max"), minx=("x", "min"), maxx=("x", "max")).reset_index()
            out.append(g.assign(page=pdf["page"].iloc[0], label=label))
        all_ = pd.concat(out)
        return all_[all_["n"] >= min_cells][["page", "label", "component", "n", "miny", "maxy", "minx", "maxx"]]

    return cells.groupBy("page").applyInPandas(run, "page long, label long, component long, n long, miny long, maxy long, minx long, maxx long")


def _median(values: np.ndarray) -> float:
    """Of a few values; ``np.median`` takes some ten times as long for them."""
    v, n = np.sort(values), len(values)
    return float(v[n // 2]) if n % 2 else float((v[n // 2 - 1] + v[n // 2]) / 2)


def _main_axis(centred: np.ndarray) -> np.ndarray:
    """The last eigenvector of the points' covariance, in the steps of ``np.cov``."""
    x = np.array(centred.T)
    x -= x.mean(axis=1)[:, None]
    return np.linalg.eigh(np.dot(x, x.T.conj()) * np.true_divide(1, x.shape[1] - 1))[1][:, -1]


def polyline_of(points: np.ndarray, step: float = 5.0) -> tuple[np.ndarray, float]:
    """Medians of the points in even bins along the main axis (at least three bins), and the thickness (median distance, doubled)."""
    centre = points.mean(0)
    axis = _main_axis(points - centre) if len(points) > 1 else np.array([1.0, 0.0])
    axis = axis if (axis[0], axis[1]) > (0, 0) or axis[0] > 1e-12 else -axis
    along, across = (points - centre) @ axis, (points - centre) @ np.array([-axis[1], axis[0]])
    bins = max(3, int(np.ptp(along) / step))
    edges = np.linspace(along.min(), along.max(), bins + 1)
    order = np.argsort(along)
    along, across, (x, y) = along[order], across[order], points[order].T
    path, widths = [], []
    for a, b in zip(np.searchsorted(along, edges[:-1]).tolist(), np.searchsorted(along, edges[1:], "right").tolist(), strict=True):
        if a < b:
            path.append((_median(x[a:b]), _median(y[a:b])))
            widths.append(_median(np.abs(across[a:b] - _median(across[a:b]))))
    return np.array(path), 2 * _median(np.array(widths)) if widths else 0.0


def polylines(points: DataFrame) -> DataFrame:
    """(page, x, y) to a fitted path: i, x, y, thickness."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path, thickness = polyline_of(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"page": pdf["page"].iloc[0], "i": np.arange(len(path)), "x": np.round(path[:, 0], 6), "y": np.round(path[:, 1], 6), "thickness": round(thickness, 6)})

    return points.groupBy("page").applyInPandas(run, "page long, i long, x double, y double, thickness double")


def merged_boxes(boxes: np.ndarray, gap: float = 0.0) -> np.ndarray:
    """Boxes (minx, miny, maxx, maxy) joined while any two meet: the fixed point doesn't depend on the order."""
    left = [tuple(b) for b in boxes]
    changed = True
    while changed:
        changed, out = False, []
        for b in sorted(left):
            for i, o in enumerate(out):
                if b[0] <= o[2] + gap and o[0] <= b[2] + gap and b[1] <= o[3] + gap and o[1] <= b[3] + gap:
                    out[i] = (min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3]))
                    changed = True
                    break
            else:
                out.append(b)
        left = out
    return np.array(sorted(left))


def merge_to_fixpoint(boxes: DataFrame, gap: float = 0.0) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = merged_boxes(pdf[["minx", "miny", "maxx", "maxy"]].to_numpy(float), gap)
        return pd.DataFrame({"page": pdf["page"].iloc[0], "id": np.arange(len(m)), "minx": m[:, 0], "miny": m[:, 1], "maxx": m[:, 2], "maxy": m[:, 3]})

    return boxes.groupBy("page").applyInPandas(run, "page long, id long, minx double, miny double, maxx double, maxy double")


def hulls_meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two convex hulls have a point in common (points and lines too): no axis along or across a side holds them apart."""
    sides = np.concatenate([np.roll(h, -1, 0) - h for h in (a, b)] + [np.eye(2)])
    axes = np.concatenate((sides, sides[:, ::-1] * (-1, 1)))
    pa, pb = a @ axes.T, b @ axes.T
    return bool(((pa.min(0) <= pb.max(0)) & (pb.min(0) <= pa.max(0))).all())


def merged_hulls_of(hulls: list[np.ndarray]) -> list[tuple[list[int], np.ndarray]]:
    """(members, hull) after hulls that meet are replaced by the hull of both until no two meet; the result doesn't depend on the order."""
    live = {i: ([i], h) for i, h in enumerate(hulls)}
    bounds = np.array([[*h.min(0), *h.max(0)] for h in hulls]).reshape(-1, 4)
    todo = list(live)
    while todo:
        i = todo.pop()
        if i not in live:
            continue
        b = bounds[i]
        near = np.flatnonzero((bounds[:, :2] <= b[2:]).all(1) & (bounds[:, 2:] >= b[:2]).all(1)).tolist()
        met = [i] + [j for j in near if j != i and hulls_meet(live[i][1], live[j][1])]
        if len(met) > 1:
            hull = hull_of(np.concatenate([live[j][1] for j in met]))
            live[i] = (sorted(m for j in met for m in live[j][0]), hull)
            bounds[i] = [*hull.min(0), *hull.max(0)]
            for j in met[1:]:
                del live[j]
                bounds[j] = np.nan
            todo.append(i)
    return list(live.values())


def merged_hulls(corners: DataFrame) -> DataFrame:
    """Polygons (page, id, x, y), a row a corner, to their hulls, merged while any two of a page meet: the least id, all members, corners and area. A concave polygon counts as its hull."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(i, hull_of(p[["x", "y"]].to_numpy())) for i, p in pdf.groupby("id")]
        rows = [(pdf["page"].iloc[0], parts[m[0]][0], [parts[k][0] for k in m], [{"x": x, "y": y} for x, y in h.tolist()], area_of(h)) for m, h in merged_hulls_of([h for _, h in parts])]
        return pd.DataFrame(rows, columns=["page", "id", "members", "corners", "area"])

    return corners.groupBy("page").applyInPandas(run, "page long, id long, members array<long>, corners array<struct<x: double, y: double>>, area double")


def parallel(v: np.ndarray, w: np.ndarray) -> bool:
    """Whether two vectors run in one direction or against each other, within 30 degrees, 15 if both are long; short ones (under 3) always do."""
    nv, nw = np.hypot(*v), np.hypot(*w)
    if min(nv, nw) < 3:
        return True
    phi = np.degrees(np.arccos(np.clip(v @ w / (nv * nw), -1, 1)))
    return bool(min(phi, 180 - phi) <= (30 if min(nv, nw) < 50 else 15))


def may_join(a: np.ndarray, b: np.ndarray, horizontal: bool = True, most_distance: float = 25.0, own_lengths: bool = False) -> bool:
    """Whether path b can follow path a: not from one and the same end, b starts onward in the label's direction, the gap runs parallel to the longer path (judged with ``own_lengths`` only, as in ``lines.join_code``), and b starts beside it by no more than the distance."""
    if (a[0] == b[0]).all() or (a[-1] == b[-1]).all():
        return False
    gap = b[0] - a[-1]
    if gap[0 if horizontal else 1] < 0:
        return False
    length = lambda p: np.hypot(*np.diff(p, axis=0).T).sum()
    longer = a if length(a) > length(b) else b
    v = longer[-1] - longer[0]
    nv = np.hypot(*v)
    if own_lengths and not parallel(v, gap):
        return False
    return bool(nv == 0 or abs((a[0] - b[0]) @ np.array([-v[1], v[0]])) / nv <= most_distance)


def _greedy_chains(segments: np.ndarray, reach: float, horizontal: bool, own_lengths: bool = False) -> tuple[list[tuple[int, int]], list[tuple[list[int], np.ndarray]]]:
    """The joins in the order made, and (members, path) of each chain that is left."""
    starts, ends = segments[:, :2], segments[:, 2:]
    d = np.hypot(*(ends[:, None, :] - starts[None, :, :]).transpose(2, 0, 1))
    a, b = np.nonzero((d < reach) & ~np.eye(len(segments), dtype=bool))
    chosen, used_end, used_start = [], set(), set()
    chain = {i: ([i], segments[i].reshape(2, 2).astype(float)) for i in range(len(segments))}
    for i in np.lexsort((b, a, d[a, b])):
        p, q = int(a[i]), int(b[i])
        if p in used_end or q in used_start or chain[p] is chain[q] or not may_join(chain[p][1], chain[q][1], horizontal, own_lengths=own_lengths):
            continue
        path = smoothed_at(np.concatenate((chain[p][1], chain[q][1])), len(chain[p][1]))
        whole = (chain[p][0] + chain[q][0], path)
        chain.update(dict.fromkeys(whole[0], whole))
        chosen.append((p, q))
        used_end.add(p)
        used_start.add(q)
    return chosen, [c for i, c in chain.items() if c[0][0] == i]


def greedy_endpoint_merges(segments: np.ndarray, reach: float, horizontal: bool = True) -> list[tuple[int, int]]:
    """Pairs of segments (x0, y0, x1, y1) joined end to start, nearest first, where the chains that they end may be joined; each end is used once. Ties by number."""
    return _greedy_chains(segments, reach, horizontal)[0]


def endpoint_merges(segments: DataFrame, reach: float = 500.0, own_lengths: bool = False) -> DataFrame:
    """(page, label, id, x0, y0, x1, y1) to the joined segments within page and label: the first member's id, all members in order and the path. Label H runs along x, others along y."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, label = pdf["id"].to_numpy(), pdf["label"].iloc[0]
        chains = _greedy_chains(pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), reach, label == "H", own_lengths)[1]
        rows = [(pdf["page"].iloc[0], label, ids[m[0]], [int(ids[i]) for i in m], [{"x": float(x), "y": float(y)} for x, y in path]) for m, path in chains]
        return pd.DataFrame(rows, columns=["page", "label", "id", "members", "path"])

    return segments.groupBy("page", "label").applyInPandas(run, "page long, label string, id long, members array<long>, path array<struct<x: double, y: double>>")


def xy_cut(boxes: np.ndarray, gap: float = 0.0) -> list[str]:
    """The path of each box in the tree of alternating cuts at empty strips, horizontal ones first; sorting by path gives the reading order."""
    paths = [""] * len(boxes)

    def strips(rows: list[int], axis: int) -> list[list[int]]:
        order = sorted(rows, key=lambda i: (boxes[i][axis], boxes[i][axis + 2], i))
        out, reach = [[order[0]]], boxes[order[0]][axis + 2]
        for i in order[1:]:
            if boxes[i][axis] > reach + gap:
                out.append([])
            out[-1].append(i)
            reach = max(reach, boxes[i][axis + 2])
        return out

    todo = [(list(range(len(boxes))), "")]
    while todo:
        rows, path = todo.pop()
        parts = strips(rows, 1)
        if len(parts) == 1:
            parts = strips(rows, 0)
        if len(parts) == 1:
            for n, i in enumerate(sorted(rows, key=lambda i: (boxes[i][1], boxes[i][0], i))):
                paths[i] = f"{path}/{n:04d}"
        else:
            todo += [(part, f"{path}/{n:04d}") for n, part in enumerate(parts)]
    return paths


def reading_order(boxes: DataFrame, gap: float = 0.0) -> DataFrame:
    """(page, id, minx, miny, maxx, maxy) to path and place from 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        paths = xy_cut(pdf[["minx", "miny", "maxx", "maxy"]].to_numpy(float), gap)
        out = pd.DataFrame({"page": pdf["page"], "id": pdf["id"], "path": paths}).sort_values("path")
        return out.assign(place=np.arange(1, len(out) + 1))

    return boxes.groupBy("page").applyInPandas(run, "page long, id long, path string, place long")


def rasterised(ring: np.ndarray) -> np.ndarray:
    """(y, x) of the cells whose centre lies in a ring."""
    if len(ring) < 3:
        return np.zeros((0, 2), int)
    low, high = np.floor(ring.min(0)).astype(int), np.ceil(ring.max(0)).astype(int)
    ys, xs = np.mgrid[low[1] : high[1] + 1, low[0] : high[0] + 1]
    px, py = xs + 0.5, ys + 0.5
    inside = np.zeros(px.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
        if ay != by:
            inside ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    return np.stack((ys[inside], xs[inside]), 1)


def cells_of_rings(rings: DataFrame) -> DataFrame:
    """Polygons (page, id, x, y as arrays) to the cells (page, id, y, x) whose centre they hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for page, i, x, y in zip(pdf["page"], pdf["id"], pdf["x"], pdf["y"], strict=True):
                at = rasterised(np.stack((x, y), 1))
                yield pd.DataFrame({"page": page, "id": i, "y": at[:, 0], "x": at[:, 1]})

    return rings.select("page", "id", "x", "y").mapInPandas(run, "page long, id long, y int, x int")


def labels_in_rings(plane: DataFrame, rings: DataFrame) -> DataFrame:
    """(page, id, y, x, label) of the label plane (page, y, x, label) inside each polygon. A merge join: Spark knows the size of the polygons, not that of their cells."""
    return cells_of_rings(rings).hint("merge").join(plane.select("page", "y", "x", "label"), ["page", "y", "x"]).select("page", "id", "y", "x", "label")
