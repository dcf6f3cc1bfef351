"""Overlays of polygons, text and table polygons about separators, curves through separators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, curves, overlays, planes
from . import roles
from .registry import query

_BARS = f"""WITH {roles.SEGMENTS}, bar AS (SELECT page, label, x0::INTEGER AS x0, y0::INTEGER AS y0, (x1 + thickness)::INTEGER AS x1, (y1 + thickness)::INTEGER AS y1 FROM seg),
cell AS (SELECT DISTINCT page, label, x, y FROM (SELECT page, label, y0, y1, unnest(range(x0, x1)) AS x FROM bar), LATERAL (SELECT unnest(range(y0, y1)) AS y))"""


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Segments as boxes of their thickness."""
    s = roles.segments(spark, d)
    x1, y1 = F.col("x1") + F.col("thickness"), F.col("y1") + F.col("thickness")
    return s.select("page", "label", F.array("x0", x1, x1, F.col("x0")).alias("x"), F.array("y0", "y0", y1, y1).alias("y"))


def _overlay_sql(kept: str) -> str:
    return f"""{_BARS}, kept AS ({kept}), near AS (SELECT a.page, count(*) AS n FROM kept a JOIN kept b ON a.page = b.page AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.page)
SELECT page, count(*)::DOUBLE AS area, (4 * count(*) - coalesce(any_value(n), 0))::DOUBLE AS border FROM kept LEFT JOIN near USING (page) GROUP BY page"""


def _measured(rings: DataFrame) -> DataFrame:
    ahead = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
    steps = F.zip_with(F.zip_with("x", ahead("x"), lambda a, b: F.abs(b - a)), F.zip_with("y", ahead("y"), lambda a, b: F.abs(b - a)), lambda a, b: a + b)
    border = F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)
    return rings.groupBy("page").agg(F.sum("area").alias("area"), F.sum(border).alias("border"))


@query(_overlay_sql("SELECT DISTINCT page, x, y FROM cell"))
def polygon_union(spark: SparkSession, d: str) -> DataFrame:
    """Area and length of the border of all bars of a page."""
    b = _bars(spark, d)
    return _measured(overlays.overlaid(b.filter("label = 8"), b.filter("label = 9"), "union"))


@query(_overlay_sql("SELECT page, x, y FROM cell WHERE label = 8 EXCEPT SELECT page, x, y FROM cell WHERE label = 9"))
def polygon_difference(spark: SparkSession, d: str) -> DataFrame:
    """Horizontal bars less the vertical ones."""
    b = _bars(spark, d)
    return _measured(overlays.overlaid(b.filter("label = 8"), b.filter("label = 9"), "difference"))


_PAINTED = """painted AS (SELECT c_custkey // 24 AS page, c_custkey AS id, list_extract([4, 2, 5, 11, 9, 4], (c_custkey % 6 + 1)::INTEGER) AS label, c_custkey * 37 % 110 AS x, c_custkey * 91 % 110 AS y,
CASE WHEN c_custkey % 6 = 4 THEN 6 ELSE c_custkey % 23 + 24 END AS w, CASE WHEN c_custkey % 6 = 4 THEN 50 ELSE c_custkey % 17 + 14 END AS h FROM customer)"""


def _painted(spark: SparkSession, d: str) -> DataFrame:
    """24 boxes a page: text, tables, pictures and upright separators (9)."""
    k = F.col("c_custkey")
    thin = k % 6 == 4
    label = F.element_at(F.array(*map(F.lit, (4, 2, 5, 11, 9, 4))), (k % 6 + 1).cast("int"))
    w, h = F.when(thin, 6).otherwise(k % 23 + 24), F.when(thin, 50).otherwise(k % 17 + 14)
    return roles.table(spark, d, "customer").select(F.floor(k / 24).alias("page"), k.alias("id"), label.alias("label"), (k * 37 % 110).alias("x"), (k * 91 % 110).alias("y"), w.alias("w"), h.alias("h"))


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The boxes as planes, the later one on top, and the separators as paths down their middle."""
    boxes = _painted(spark, d)
    middle, end = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h")
    paths = boxes.filter("label = 9").select("page", "id", F.array(middle, middle).alias("x"), F.array(F.col("y").cast("double"), end.cast("double")).alias("y"))
    return planes.painted(boxes, 160, 160), paths


@query()
def text_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Text of painted pages, parted about separators, less pictures."""
    return blocks.text_polygons(*_pages(spark, d))


@query()
def table_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Tables of painted pages."""
    return blocks.table_polygons(*_pages(spark, d))


@query(f"""WITH {_PAINTED}, bar AS (SELECT page, id AS block, x + w / 2 AS middle, y AS head FROM painted WHERE label = 9)
SELECT p.page, block, id, CASE WHEN y + h / 2 < head THEN 'top' WHEN x + w / 2 < middle THEN 'left' ELSE 'right' END AS side FROM painted p JOIN bar USING (page) WHERE label <> 9""")
def separator_sides(spark: SparkSession, d: str) -> DataFrame:
    """On which side of each separator of its page the centre of a box lies."""
    boxes = _painted(spark, d)
    centres = boxes.filter("label <> 9").select("page", "id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    middle = F.col("x") + F.col("w") / 2
    bars = boxes.filter("label = 9").select("page", F.col("id").alias("block"), F.array(middle, middle).alias("x"), F.array(F.col("y").cast("double"), (F.col("y") + F.col("h")).cast("double")).alias("y"))
    return blocks.separator_sides(centres.join(bars.select("page", "block"), "page"), bars)


def _bows(spark: SparkSession, d: str) -> DataFrame:
    """Separators of painted pages as bows of 13 points through half of the page, level ones (H) and upright ones (V)."""
    k = F.col("c_custkey")
    at = lambda i: (i * 6 + k * 37 % 80).cast("double")
    bow = lambda i: (k * 91 % 120 + 20 + (i * (12 - i)) * (k % 5 - 2) / 6).cast("double")
    level, steps = k % 12 == 4, F.sequence(F.lit(0), F.lit(12))
    s = roles.table(spark, d, "customer").filter("c_custkey % 6 = 4").select(F.floor(k / 24).alias("page"), F.when(level, "H").otherwise("V").alias("kind"), k.alias("id"), F.transform(steps, at).alias("a"), F.transform(steps, bow).alias("b"))
    return s.select("page", "kind", "id", F.when(F.col("kind") == "H", F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("kind") == "H", F.col("b")).otherwise(F.col("a")).alias("y"))


@query(f"""WITH {roles.SEGMENTS}, line AS (SELECT *, label = 8 AS level FROM seg WHERE x0 <> x1 OR y0 <> y1), step AS (SELECT unnest(range(10)) AS i)
SELECT page, id, i::INTEGER AS i, round(CASE WHEN level THEN i * 64 / 9.0 ELSE x0 + thickness * (i * 64 / 9.0 - y0) / (y1 - y0) END, 6) AS x, round(CASE WHEN level THEN y0 + thickness * (i * 64 / 9.0 - x0) / (x1 - x0) ELSE i * 64 / 9.0 END, 6) AS y FROM line, step""")
def cut_paths(spark: SparkSession, d: str) -> DataFrame:
    """Slanted segments made as long as the page."""
    s = roles.segments(spark, d).filter("x0 <> x1 or y0 <> y1")
    level = F.col("label") == 8
    paths = s.select("page", F.when(level, "H").otherwise("V").alias("kind"), "id", F.array("x0", F.when(level, F.col("x1")).otherwise(F.col("x0") + F.col("thickness"))).alias("x"), F.array("y0", F.when(level, F.col("y0") + F.col("thickness")).otherwise(F.col("y1"))).alias("y"), F.lit(64.0).alias("width"), F.lit(64.0).alias("height"))
    out = curves.cut_paths(paths).select("page", "id", F.posexplode(F.arrays_zip("x", "y")).alias("i", "p"))
    return out.select("page", "id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query()
def page_split_along(spark: SparkSession, d: str) -> DataFrame:
    """Painted pages split along bowed separators into frames in reading order."""
    boxes = _painted(spark, d).filter("label <> 9")
    x1, y1 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ring = lambda *c: F.array(*[F.col(v).cast("double") if isinstance(v, str) else v.cast("double") for v in c])
    content = boxes.select("page", ring("x", x1, x1, "x").alias("x"), ring("y", "y", y1, y1).alias("y"))
    pages = boxes.select("page", F.lit(160.0).alias("width"), F.lit(160.0).alias("height")).distinct()
    return curves.split_pages_along(pages, content, _bows(spark, d))
