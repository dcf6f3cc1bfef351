"""Segments made longer up to the first obstacle, and directions that outliers don't turn."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOUCH = 1e-9


def clipped_rays(segments: DataFrame, share: float = 0.2) -> DataFrame:
    """Segments (page, id, x0, y0, x1, y1) made longer at both ends by a share of their length, but no further than the nearest other segment of the page: page, id, x0, y0, x1, y1.

    An obstacle that a ray meets where it begins stops it there. Segments that lie on one line with the ray don't stop it. A segment of one point stays.
    """
    s = segments.select("page", "id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    end = lambda e, x, y, dx, dy: F.struct(F.lit(e).alias("e"), x.alias("x"), y.alias("y"), (dx * share).alias("dx"), (dy * share).alias("dy"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rays = s.select("page", "id", F.explode(F.array(end(0, F.col("x0"), F.col("y0"), -dx, -dy), end(1, F.col("x1"), F.col("y1"), dx, dy))).alias("r")).select("page", "id", "r.*")
    other = s.select("page", F.col("id").alias("other"), F.col("x0").alias("ox"), F.col("y0").alias("oy"), (F.col("x1") - F.col("x0")).alias("ex"), (F.col("y1") - F.col("y0")).alias("ey"))
    x, y, ox, oy, ex, ey = (F.col(c) for c in ("x", "y", "ox", "oy", "ex", "ey"))
    turn = F.col("dx") * ey - F.col("dy") * ex
    along = F.try_divide((ox - x) * ey - (oy - y) * ex, turn)  # on the ray, from 0 to 1
    beside = F.try_divide((ox - x) * F.col("dy") - (oy - y) * F.col("dx"), turn)  # on the other segment
    met = rays.join(other, "page").filter(F.col("id") != F.col("other")).filter(along.between(-_TOUCH, 1) & beside.between(-_TOUCH, 1 + _TOUCH))
    nearest = met.groupBy("page", "id", "e").agg(F.greatest(F.min(along), F.lit(0.0)).alias("t"))
    ends = rays.join(nearest, ["page", "id", "e"], "left").withColumn("t", F.coalesce("t", F.lit(1.0)))
    at = lambda c, e: F.max(F.when(F.col("e") == e, F.col(c) + F.col("t") * F.col(f"d{c}"))).alias(f"{c}{e}")
    return ends.groupBy("page", "id").agg(at("x", 0), at("y", 0), at("x", 1), at("y", 1))


def consensus(points: np.ndarray, name: str, trials: int = 1000, residual: float = 1.0) -> np.ndarray | None:
    """Which points lie within the residual of the line that most points agree on; none for under three points.

    Pairs of points are drawn by a hash of the name, all pairs where there are no more than the trials. Ties go to the least sum of squares, then to the first pair.
    """
    points = np.asarray(points, float)
    n = len(points)
    if n < 3:
        return None
    if n * (n - 1) // 2 <= trials:
        i, j = np.triu_indices(n, 1)
    else:
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        i = rng.integers(0, n, trials)
        j = (i + rng.integers(1, n, trials)) % n
    v = points[j] - points[i]
    length = np.hypot(*v.T)
    i, v, length = i[length > 0], v[length > 0], length[length > 0]
    if not len(i):
        return np.ones(n, bool)
    off = np.abs(v[:, :1] * (points[None, :, 1] - points[i, 1:]) - v[:, 1:] * (points[None, :, 0] - points[i, :1])) / length[:, None]
    near = off < residual
    best = np.lexsort((np.round(np.where(near, off**2, 0).sum(1), 9), -near.sum(1)))[0]
    return near[best]


def consensus_angle(points: np.ndarray, name: str, orthogonal: bool = False, trials: int = 1000, residual: float = 1.0) -> float | None:
    """Degrees in [-90, 90] between the vertical and the line through the points that agree, fitted again to all of them; between it and the horizontal if ``orthogonal``."""
    near = consensus(points, name, trials, residual)
    if near is None:
        return None
    own = np.asarray(points, float)[near]
    axis = np.linalg.eigh(np.cov((own - own.mean(0)).T))[1][:, -1]
    main = axis[0] if abs(axis[0]) > abs(axis[1]) else axis[1]
    axis = axis if main > 0 else -axis  # flat lines run to the right, steep ones down the page
    phi = np.pi / 2 - np.arctan2(axis[1], axis[0]) - (np.pi / 2 if orthogonal else 0)
    return float(np.degrees(np.arcsin(np.sin(phi)))) if abs(np.sin(phi)) < 1 - 1e-12 else 90.0


def consensus_angles(points: DataFrame, orthogonal: bool = False) -> DataFrame:
    """(page, id, x, y), a row a point, to page, id, n, agreeing and angle of each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy, page, i = pdf.sort_values(["x", "y"])[["x", "y"]].to_numpy(float), pdf["page"].iloc[0], pdf["id"].iloc[0]
        near = consensus(xy, f"{page}/{i}")
        angle = consensus_angle(xy, f"{page}/{i}", orthogonal)
        return pd.DataFrame({"page": [page], "id": [i], "n": [len(xy)], "agreeing": [0 if near is None else int(near.sum())], "angle": [angle]}).astype({"angle": float})

    return points.groupBy("page", "id").applyInPandas(run, "page long, id long, n long, agreeing long, angle double")
