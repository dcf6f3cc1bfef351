"""Pages cut by their separators into frames in reading order, page by page with Arrow.

A page is a bounded unit (one scanned sheet), so a group never grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TIE = 1e-6  # lengths this near are equal


def clipped(ring: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The part of a convex ring where ``side``, a signed distance of each corner, isn't negative."""
    out = []
    for i in range(len(ring)):
        j = (i + 1) % len(ring)
        if side[i] >= 0:
            out.append(ring[i])
        if side[i] * side[j] < 0:
            out.append(ring[i] + (ring[j] - ring[i]) * side[i] / (side[i] - side[j]))
    return np.array(out)


def centroid(ring: np.ndarray) -> np.ndarray:
    nxt = np.roll(ring, -1, 0)
    cross = ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]
    area = cross.sum()
    return ((ring + nxt) * cross[:, None]).sum(0) / (3 * area) if area else ring.mean(0)


def length_inside(ring: np.ndarray, line: np.ndarray) -> float:
    """Length of a line (two ends) within a convex ring, its border included."""
    middle, way, low, high = ring.mean(0), line[1] - line[0], 0.0, 1.0
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        n = np.array([a[1] - b[1], b[0] - a[0]])
        n = n if (middle - a) @ n >= 0 else -n
        start, rate = (line[0] - a) @ n, way @ n
        if rate == 0 and start < 0:
            return 0.0
        if rate > 0:
            low = max(low, -start / rate)
        elif rate < 0:
            high = min(high, -start / rate)
    return max(0.0, high - low) * float(np.hypot(*way))


def _normal(line: np.ndarray) -> np.ndarray:
    """Across a line: downwards of a level one, to the right of an upright one."""
    n = np.array([line[0][1] - line[1][1], line[1][0] - line[0][0]])
    return n if (n[1], n[0]) > (0, 0) else -n


def _crosses(content: list[np.ndarray], lines: list[np.ndarray]) -> np.ndarray:
    """Whether each line meets any of the rings."""
    if not content or not lines:
        return np.zeros(len(lines), bool)
    corners, starts = np.concatenate(content), np.cumsum([0, *map(len, content[:-1])])
    normals = np.array([_normal(line) for line in lines])
    side = corners @ normals.T - (normals * np.array([line[0] for line in lines])).sum(1)
    return ((np.minimum.reduceat(side, starts) <= 0) & (np.maximum.reduceat(side, starts) >= 0)).any(0)


def split_frames(frame: np.ndarray, content: list[np.ndarray], lines: list[tuple[str, int, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
    """(path, frame) of the leaves in reading order; lines are (label H or V, id, ends).

    The cut is a separator that crosses no content of the frame, else any; horizontal ones before
    vertical ones, then the topmost or leftmost by centre, then by id. A frame that its cut doesn't
    divide stays whole. Other separators go to the part that has more of their length, the first one in a tie.
    """
    todo, leaves = [("", frame, content, lines)], []
    while todo:
        path, frame, content, lines = todo.pop()
        crosses = _crosses(content, [line for _, _, line in lines])
        ranked = sorted(range(len(lines)), key=lambda i: (crosses[i], lines[i][0] != "H", lines[i][2].mean(0)[1 if lines[i][0] == "H" else 0], lines[i][1]))
        side = (frame - lines[ranked[0]][2][0]) @ _normal(lines[ranked[0]][2]) if ranked else np.zeros(1)
        if not side.min() < 0 < side.max():
            leaves.append((path, frame))
            continue
        label, _, cut = lines[ranked[0]]
        pieces = [(r, (r - cut[0]) @ _normal(cut)) for r in content]
        parts = []
        for sign in (-1, 1):
            held = [clipped(r, sign * d) if d.min() < 0 < d.max() else r for r, d in pieces if (sign * d).max() > 0]
            parts.append((clipped(frame, sign * side), held))
        parts.sort(key=lambda p: centroid(p[0])[1 if label == "H" else 0])
        rest = [lines[i] for i in ranked[1:]]
        second = [length_inside(parts[1][0], s[2]) > length_inside(parts[0][0], s[2]) + TIE for s in rest]
        todo += [(f"{path}/{k}", *parts[k], [s for s, late in zip(rest, second, strict=True) if late == bool(k)]) for k in (1, 0)]
    return leaves


def split_pages(parts: DataFrame) -> DataFrame:
    """(page, kind, id, x0, y0, x1, y1) to the frames of each page in reading order.

    Kinds: ``frame`` (one box a page; pages without one give nothing), ``content`` (boxes) and ``H`` or ``V`` (separators from end to end; one whose
    ends are the same point cuts nothing and is left out). A separator cuts along the straight line through its ends.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        box = lambda r: np.array([[r.x0, r.y0], [r.x1, r.y0], [r.x1, r.y1], [r.x0, r.y1]], float)
        rows = list(pdf.itertuples())
        frames = [box(r) for r in rows if r.kind == "frame"]
        columns = ["page", "leaf", "path", "x", "y"]
        if not frames:
            return pd.DataFrame(columns=columns)
        inside = lambda r: max(r.x0, frames[0][0][0]) < min(r.x1, frames[0][2][0]) and max(r.y0, frames[0][0][1]) < min(r.y1, frames[0][2][1])
        low, high = frames[0][0], frames[0][2]
        content = [np.clip(box(r), low, high) for r in rows if r.kind == "content" and inside(r)]
        lines = [(r.kind, r.id, np.array([[r.x0, r.y0], [r.x1, r.y1]], float)) for r in rows if r.kind in ("H", "V") and (r.x0, r.y0) != (r.x1, r.y1)]
        leaves = split_frames(frames[0], content, lines)
        return pd.DataFrame([(rows[0].page, i + 1, path, ring[:, 0].tolist(), ring[:, 1].tolist()) for i, (path, ring) in enumerate(leaves)], columns=columns)

    return parts.groupBy("page").applyInPandas(run, "page long, leaf long, path string, x array<double>, y array<double>")
