"""Two-point lines and paths as column expressions over x0, y0, x1, y1 or an array of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import parallel


def length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def direction(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Unit vector; (0, 0) for a point."""
    n = length(x0, y0, x1, y1)
    return F.coalesce(F.try_divide(x1 - x0, n), F.lit(0.0)), F.coalesce(F.try_divide(y1 - y0, n), F.lit(0.0))


def normal(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    vx, vy = direction(x0, y0, x1, y1)
    return -vy, vx


def angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.degrees(F.atan2(y1 - y0, x1 - x0))


def centre(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    return (x0 + x1) / 2, (y0 + y1) / 2


def levelled(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """The horizontal line with the same centre and length."""
    (cx, cy), half = centre(x0, y0, x1, y1), length(x0, y0, x1, y1) / 2
    return cx - half, cy, cx + half, cy


def path_length(path: Column) -> Column:
    """Length of array<struct<x, y>>."""
    n = F.size(path)
    steps = F.zip_with(F.slice(path, 1, F.greatest(n - 1, F.lit(0))), F.slice(path, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def ends(path: Column) -> tuple[Column, Column]:
    return F.element_at(path, 1), F.element_at(path, -1)


#: Outcomes of joining two segments, in the order in which they are tested.
JOIN_CODES = ("label", "collapse", "direction", "parallel", "distance", "mask", "joined")


def nearest_ends(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """struct(d, i, j): the nearest pair of endpoints (0: start, 1: end) of two segments; ties go to the lower i, then j."""
    pair = lambda i, j: F.struct(F.hypot(b[f"x{j}"] - a[f"x{i}"], b[f"y{j}"] - a[f"y{i}"]).alias("d"), F.lit(i).alias("i"), F.lit(j).alias("j"))
    return F.least(pair(0, 0), pair(0, 1), pair(1, 0), pair(1, 1))


def join_code(a: dict[str, Column], b: dict[str, Column], mask_free: Column, most_distance: float = 25.0, own_lengths: bool = False) -> Column:
    """Why segments a and b (x0, y0, x1, y1, label) can't be joined at their nearest ends, or 'joined'.

    The tests: equal labels; no common start and no common end; from a's end the gap leads on along the
    label's main axis (8 along x, others along y), from a's start back; the gap runs parallel to
    the longer segment; the starts lie no further apart across the longer segment than the distance; nothing
    else lies in the corridor. Segments enter the parallel test as unit vectors, which it takes for too short
    to tell, so it rejects nothing unless ``own_lengths`` are asked for.
    """
    near = nearest_ends(a, b)
    end = lambda s, at, c: F.when(at == 0, s[f"{c}0"]).otherwise(s[f"{c}1"])
    gx, gy = end(b, near["j"], "x") - end(a, near["i"], "x"), end(b, near["j"], "y") - end(a, near["i"], "y")
    onward = F.when(a["label"] == 8, gx).otherwise(gy)
    la, lb = (length(s["x0"], s["y0"], s["x1"], s["y1"]) for s in (a, b))
    vx, vy = (F.when(la > lb, a[f"{c}1"] - a[f"{c}0"]).otherwise(b[f"{c}1"] - b[f"{c}0"]) for c in "xy")
    n = F.greatest(la, lb)
    apart = F.abs((a["y0"] - b["y0"]) * vx - (a["x0"] - b["x0"]) * vy)
    along = parallel(vx, vy, gx, gy) if own_lengths else F.lit(True)
    same = lambda k: (a[f"x{k}"] == b[f"x{k}"]) & (a[f"y{k}"] == b[f"y{k}"])
    return (
        F.when(a["label"] != b["label"], "label")
        .when(same(0) | same(1), "collapse")
        .when(F.when(near["i"] == 1, onward < 0).otherwise(onward > 0), "direction")
        .when(~along, "parallel")
        .when(F.coalesce(F.try_divide(apart, n) > most_distance, F.lit(False)), "distance")
        .when(~mask_free, "mask")
        .otherwise("joined")
    )
