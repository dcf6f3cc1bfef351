"""Range and spatial joins by bucketing: equi-joins on grid cells, then the exact predicate.

Each match is kept in one cell only, the larger of both first cells, so nothing has to
be made distinct afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / width), F.greatest(F.floor(low / width), F.floor(high / width)))


def interval_pairs(spans: DataFrame, width: float, shrink: float = 3.0) -> DataFrame:
    """(page, id, other) where [lo, hi + 1) meets the other's [lo + shrink, hi + 1 - shrink)."""
    kept = spans.select("page", "id", "lo", "hi", F.explode(_cells(F.col("lo"), F.col("hi") + 1, width)).alias("cell")).withColumn("first", F.floor(F.col("lo") / width))
    asked = spans.select(F.col("page").alias("p2"), F.col("id").alias("other"), (F.col("lo") + shrink).alias("qlo"), (F.col("hi") + 1 - shrink).alias("qhi"))
    asked = asked.select("*", F.explode(_cells(F.col("qlo"), F.col("qhi"), width)).alias("c2")).withColumn("f2", F.floor(F.col("qlo") / width))
    meets = (F.col("lo") < F.col("qhi")) & (F.col("qlo") < F.col("hi") + 1) & (F.col("id") != F.col("other"))
    both = kept.join(asked, (F.col("page") == F.col("p2")) & (F.col("cell") == F.col("c2")))
    return both.filter(meets & (F.col("cell") == F.greatest("first", "f2"))).select("page", "id", "other")


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(page, a, b, d) of points closer than the radius, a < b."""
    own = points.select("page", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = points.select("page", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(steps).alias("s"))
    around = around.select("page", "b", "bx", "by", (F.floor(F.col("bx") / radius) + F.col("s.i")).alias("cx"), (F.floor(F.col("by") / radius) + F.col("s.j")).alias("cy"))
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return own.join(around, ["page", "cx", "cy"]).filter(F.col("a") < F.col("b")).withColumn("d", d).filter(F.col("d") < radius).select("page", "a", "b", "d")


def following(ends: DataFrame, starts: DataFrame, radius: float) -> DataFrame:
    """(page, a, b) of an end (page, a, x, y) and another segment's start (page, b, x, y) closer than the radius."""
    cell = lambda c: F.floor(F.col(c) / radius)
    own = ends.select("page", "a", F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = starts.select("page", "b", F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(steps).alias("s"))
    around = around.select("page", "b", "bx", "by", (cell("bx") + F.col("s.i")).alias("cx"), (cell("by") + F.col("s.j")).alias("cy"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return own.join(around, ["page", "cx", "cy"]).filter((F.col("a") != F.col("b")) & (F.sqrt(dx * dx + dy * dy) < radius)).select("page", "a", "b")


def _gridded(boxes: DataFrame, prefix: str, width: float) -> DataFrame:
    c = lambda n: F.col(f"{prefix}{n}")
    out = boxes.withColumn("gx", F.explode(_cells(c("minx"), c("maxx"), width)))
    return out.withColumn("gy", F.explode(_cells(c("miny"), c("maxy"), width)))


def box_pairs(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Rows of both sides (page, id, minx, miny, maxx, maxy) whose boxes meet; right columns start with r_."""
    renamed = right.select("page", *[F.col(c).alias(f"r_{c}") for c in ("id", "minx", "miny", "maxx", "maxy")])
    both = _gridded(left, "", width).join(_gridded(renamed, "r_", width), ["page", "gx", "gy"])
    meets = (F.col("minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("maxx")) & (F.col("miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("maxy"))
    once = (F.col("gx") == F.greatest(F.floor(F.col("minx") / width), F.floor(F.col("r_minx") / width))) & (F.col("gy") == F.greatest(F.floor(F.col("miny") / width), F.floor(F.col("r_miny") / width)))
    return both.filter(meets & once).drop("gx", "gy")


def unstopped(boxes: DataFrame, stoppers: DataFrame, width: float) -> DataFrame:
    """Boxes that meet no stopper."""
    hit = box_pairs(boxes, stoppers, width).select("page", "id").distinct()
    return boxes.join(hit, ["page", "id"], "left_anti")


def containing(points: DataFrame, boxes: DataFrame, width: float, margin: float = 5.0) -> DataFrame:
    """(page, id, box) of the first box, by its number, whose inside less the margin holds the point."""
    small = boxes.select("page", "id", *[(F.col(c) + s * margin).alias(c) for c, s in (("minx", 1), ("miny", 1), ("maxx", -1), ("maxy", -1))]).filter((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")))
    dots = points.select("page", "id", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    return box_pairs(dots, small, width).groupBy("page", "id").agg(F.min("r_id").alias("box"))


def most_overlap(spans: DataFrame, frames: DataFrame, width: float) -> DataFrame:
    """Each span (page, id, lo, hi) with the frame that it overlaps longest; ties go to the lower frame, and a span that overlaps none to the first frame of its page."""
    s = spans.select("page", "id", "lo", "hi", F.explode(_cells(F.col("lo"), F.col("hi"), width)).alias("cell"))
    f = frames.select("page", F.col("id").alias("frame"), F.col("lo").alias("flo"), F.col("hi").alias("fhi"), F.explode(_cells(F.col("lo"), F.col("hi"), width)).alias("cell"))
    first = F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("flo") / width))
    both = s.join(f, ["page", "cell"]).filter(F.col("cell") == first).withColumn("overlap", F.least("hi", "fhi") - F.greatest("lo", "flo")).filter(F.col("overlap") > 0)
    best = both.groupBy("page", "id").agg(F.max_by(F.struct("frame", "overlap"), F.struct(F.col("overlap"), -F.col("frame"))).alias("b"))
    default = frames.groupBy("page").agg(F.min("id").alias("frame0"))
    named = spans.select("page", "id").join(default, "page").join(best, ["page", "id"], "left")
    return named.select("page", "id", F.coalesce("b.frame", "frame0").alias("frame"), F.coalesce("b.overlap", F.lit(0.0)).alias("overlap"))


def split_choice(candidates: DataFrame) -> DataFrame:
    """The separator that cuts each frame: not crossing content first, horizontal before vertical, then topmost or leftmost."""
    order = F.struct(F.col("crosses").cast("int"), (F.col("label") != "H").cast("int"), F.when(F.col("label") == "H", F.col("y")).otherwise(F.col("x")), F.col("id"))
    return candidates.groupBy("frame").agg(F.min_by("id", order).alias("id"))


def weighted_angle(segments: DataFrame) -> DataFrame:
    """The skew of each page in degrees, weighted by length, from segments (page, label, n_points, x0, y0, x1, y1).

    Vertical lines and table columns (9, 7) measure it against the vertical; on pages without them
    horizontal lines (8) against the horizontal. Paths of fewer than three points don't count, nor do table columns beyond 15
    degrees, which belong to rotated tables. Null where nothing is left.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length, up = F.hypot(dx, dy), F.col("label").isin(7, 9)
    turned = F.when(F.abs(dx) > F.abs(dy), F.pi() / 2 - F.atan2(dy, dx)).otherwise(F.pi() / 2 + F.atan2(dy, dx)) - F.when(F.col("label") == 8, F.pi() / 2).otherwise(0.0)
    phi = F.degrees(F.asin(F.sin(turned)))
    used = segments.select("page", "label", up.alias("up"), length.alias("length"), phi.alias("phi"), ((F.col("n_points") >= 3) & ~((F.col("label") == 7) & (F.abs(phi) > 15))).alias("good"))
    mean = lambda which: F.try_divide(F.sum(F.when(which & F.col("good"), F.col("phi") * F.col("length"))), F.sum(F.when(which & F.col("good"), F.col("length"))))
    return used.groupBy("page").agg(F.round(F.when(F.max("up"), mean(F.col("up"))).otherwise(mean(F.col("label") == 8)), 6).alias("angle"))
