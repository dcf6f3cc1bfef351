"""Numeric column expressions with pinned rounding and division rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def truncated(x: Column, places: int = 4) -> Column:
    """Cut toward zero after ``places`` digits; noise below 1e-9 doesn't lower a digit."""
    scale = 10.0**places
    return F.signum(x) * F.floor(F.round(F.abs(x) * scale, 6)) / F.lit(scale)


def steady(x: Column, places: int = 9) -> Column:
    """Rounded so that the order of a sum doesn't show."""
    return F.round(x, places)


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors, folded to 0..90; null where a vector is zero."""
    cosine = F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return F.when(angle > 90, F.lit(180.0) - angle).otherwise(angle)


def parallel(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Short vectors (under 3) always are; under 50 within 30 degrees, else within 15. A cosine that rounding takes beyond 1 counts as 0 degrees, on purpose."""
    shorter = F.least(F.hypot(ax, ay), F.hypot(bx, by))
    return F.when(shorter < 3, F.lit(True)).otherwise(F.coalesce(angle_between(ax, ay, bx, by) <= F.when(shorter < 50, 30.0).otherwise(15.0), F.lit(False)))


def affine(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the 2x3 matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in m)
    return a * x + b * y + c, d * x + e * y + f


def affine_inverse(m: list[float]) -> list[float]:
    a, b, c, d, e, f = m
    det = a * e - b * d
    if det == 0:
        raise ValueError("the matrix has no inverse")
    return [e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det]


def affine_product(p: list[float], q: list[float]) -> list[float]:
    """The matrix that applies q, then p."""
    a, b, c, d, e, f = p
    g, h, i, j, k, n = q
    return [a * g + b * j, a * h + b * k, a * i + b * n + c, d * g + e * j, d * h + e * k, d * i + e * n + f]


def cosine_annealing(t: Column, total: float, low: float = 0.0, high: float = 1.0) -> Column:
    return F.lit(low) + F.lit(0.5 * (high - low)) * (1 + F.cos(F.lit(3.141592653589793) * t / F.lit(float(total))))
