"""Filters of fitted segments by quality, length and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import literal_map

# A segment of a label must be longer than this.
LONGER_THAN = {7: 0.0, 8: 10.0, 9: 10.0}


def well_fitted(segments: DataFrame, planes: DataFrame, max_error: float = 0.1, min_length: float = 1e-3) -> DataFrame:
    """Segments (page, error, length) below the error and not shorter than a share of the shorter side of their page's label plane (page, width, height)."""
    side = planes.select("page", F.least("width", "height").alias("__side"))
    near = segments.join(side, "page").filter((F.col("error") < max_error) & (F.col("length") >= min_length * F.col("__side")))
    return near.select(*segments.columns)


def long_enough(segments: DataFrame) -> DataFrame:
    """Segments (label, length) that are longer than noise of their label; other labels than separators go."""
    return segments.filter(F.col("length") > literal_map(LONGER_THAN)[F.col("label").cast("int")])


def meets_box(x0: Column, y0: Column, x1: Column, y1: Column, box: dict[str, Column]) -> Column:
    """Whether a line from end to end has a point in common with a box: their bounds overlap and the box's corners don't lie on one side."""
    bounds = (F.least(x0, x1) <= box["maxx"]) & (F.greatest(x0, x1) >= box["minx"]) & (F.least(y0, y1) <= box["maxy"]) & (F.greatest(y0, y1) >= box["miny"])
    side = lambda x, y: (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
    corners = [side(box[x], box[y]) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    return bounds & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def in_region(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Segments (page, x0, y0, x1, y1) that meet the region of their page, one box (page, minx, miny, maxx, maxy) a page; pages without one lose all."""
    names = ("minx", "miny", "maxx", "maxy")
    boxed = segments.join(regions.select("page", *[F.col(c).alias(f"__{c}") for c in names]), "page")
    met = meets_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], {c: F.col(f"__{c}") for c in names})
    return boxed.filter(met).select(*segments.columns)
