"""Page layout: cells of table rows, page frames, horizontal merges, block grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import box_pairs


def row_cells(rows: DataFrame, separators: DataFrame, width: float = 100.0) -> DataFrame:
    """Rows (page, row, minx, maxx, miny, maxy) cut at the separators (page, id, x, y0, y1) that cross them: (page, row, cell, x0, x1). ``width`` is the size of the join's grid cells."""
    boxes = rows.withColumnRenamed("row", "id").select("page", "id", "minx", "miny", "maxx", "maxy")
    walls = separators.select("page", "id", F.col("x").alias("minx"), F.col("y0").alias("miny"), F.col("x").alias("maxx"), F.col("y1").alias("maxy"))
    inside = box_pairs(boxes, walls, width).filter((F.col("r_minx") > F.col("minx")) & (F.col("r_minx") < F.col("maxx")))
    cuts = inside.select("page", F.col("id").alias("row"), F.col("r_minx").alias("x"))
    edges = cuts.unionByName(rows.select("page", "row", F.col("minx").alias("x"))).unionByName(rows.select("page", "row", F.col("maxx").alias("x"))).distinct()
    by = Window.partitionBy("page", "row").orderBy("x")
    out = edges.withColumns({"x1": F.lead("x").over(by), "cell": F.row_number().over(by)})
    return out.filter(F.col("x1").isNotNull()).select("page", "row", "cell", F.col("x").alias("x0"), "x1")


def frames(blocks: DataFrame, least_share: float = 0.1) -> DataFrame:
    """The frame of each page (page, width, minx, miny, maxx, maxy): from both sides, blocks narrower than a share of the page are noise until a wider one comes."""
    wide = (F.col("maxx") - F.col("minx")) > least_share * F.col("width")
    sides = blocks.groupBy("page").agg(F.min(F.when(wide, F.col("minx"))).alias("left"), F.max(F.when(wide, F.col("maxx"))).alias("right"))
    good = blocks.join(sides, "page").filter((F.col("minx") >= F.col("left")) & (F.col("maxx") <= F.col("right")))
    return good.groupBy("page").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def block_widths(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Blocks (page, block) with the length of their longest line (page, block, length) as ``width``; 0 without lines."""
    longest = lines.groupBy("page", "block").agg(F.max("length").alias("width"))
    return blocks.join(longest, ["page", "block"], "left").fillna(0.0, ["width"])


def grouped_lines(lines: DataFrame) -> DataFrame:
    """Lines (block, i, label, box) to one row for each run of equal labels, with its box; runs of label 5 are tables."""
    by = Window.partitionBy("block").orderBy("i")
    change = F.coalesce((F.lag("label").over(by) != F.col("label")).cast("int"), F.lit(0))
    marked = lines.withColumn("change", change).withColumn("part", F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    box = [F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]
    return marked.groupBy("block", "part", "label").agg(F.count(F.lit(1)).alias("n_lines"), *box).withColumn("kind", F.when(F.col("label") == 5, "table").otherwise("text"))


def may_merge(a: np.ndarray, b: np.ndarray) -> bool:
    """Boxes with line heights (minx, miny, maxx, maxy, height, lines): heights within 1.5, a gap up to a quarter of the wider box, and centres of single lines apart by at most half of the lesser height."""
    gap = np.hypot(max(b[0] - a[2], a[0] - b[2], 0), max(b[1] - a[3], a[1] - b[3], 0))
    low, high = sorted((a[4], b[4]))
    if low <= 0 or high > 1.5 * low or gap > 0.25 * max(a[2] - a[0], b[2] - b[0]):
        return False
    return not (a[5] == 1 and b[5] == 1 and abs(a[1] + a[3] - b[1] - b[3]) / 2 > 0.5 * low)


def _met(box: np.ndarray, others: np.ndarray) -> int:
    """How many of the boxes meet a box."""
    return int(np.count_nonzero((others[:, 0] <= box[2]) & (others[:, 2] >= box[0]) & (others[:, 1] <= box[3]) & (others[:, 3] >= box[1])))


def merged_rows(boxes: np.ndarray, stoppers: np.ndarray, min_overlap: float = 3.0, erosion: float = 20.0, rule=may_merge) -> np.ndarray:
    """Boxes side by side merge in sweeps from left to right until a sweep changes nothing.

    A box's partners in a sweep are those that overlap its height at its turn. One is merged if the rule
    allows, no stopper's box meets the line between the centres, and the box of both, less the erosion, meets
    no stopper and at most two of the boxes that the sweep began with.
    """
    rows = np.asarray(boxes, float).reshape(-1, 6)
    while True:
        rows = rows[np.lexsort(rows.T[::-1])]
        free, out = np.ones(len(rows), bool), []
        for i, a in enumerate(rows):
            if not free[i]:
                continue
            free[i] = False
            low, high = a[1] + min_overlap, a[3] + 1 - min_overlap
            for j in np.flatnonzero(free & (rows[:, 1] < high) & (rows[:, 3] + 1 > low) & (low < high)):
                b = rows[j]
                centres = np.stack((a[:2] + a[2:4], b[:2] + b[2:4])) / 2
                if not rule(a, b) or _met(np.concatenate((centres.min(0), centres.max(0))), stoppers):
                    continue
                both = np.concatenate((np.minimum(a[:2], b[:2]), np.maximum(a[2:4], b[2:4]), [min(a[4], b[4]), max(a[5], b[5])]))
                inner = both[:4] + erosion * np.array([1, 1, -1, -1])
                if (inner[:2] < inner[2:]).all() and (_met(inner, stoppers) or _met(inner, rows) > 2):
                    continue
                free[j] = False
                a = both
            out.append(a)
        if len(out) == len(rows):
            return rows
        rows = np.array(out)


def horizontal_merges(boxes: DataFrame, stoppers: DataFrame) -> DataFrame:
    """(page, minx, miny, maxx, maxy, height, n_lines) merged by page; a page's stoppers come along in a co-group."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in ("page", "minx", "miny", "maxx", "maxy", "height", "n_lines")})
        m = merged_rows(left[["minx", "miny", "maxx", "maxy", "height", "n_lines"]].to_numpy(float), right[["minx", "miny", "maxx", "maxy"]].to_numpy(float).reshape(-1, 4))
        return pd.DataFrame({"page": left["page"].iloc[0], **{c: m[:, i] for i, c in enumerate(("minx", "miny", "maxx", "maxy", "height"))}, "n_lines": m[:, 5].astype(int)})

    schema = "page long, minx double, miny double, maxx double, maxy double, height double, n_lines long"
    return boxes.groupBy("page").cogroup(stoppers.groupBy("page")).applyInPandas(run, schema)
